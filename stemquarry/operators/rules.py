"""Data-quality rules as data: each is an id, a severity and a Column predicate.

All rules of a catalogue are compiled into one array per row and one explode, so adding a rule
costs no further scan.  ``apply`` gives one issue row per hit; rules over whole papers (numbering,
counts, declared totals) are DataFrame functions that give rows of the same layout.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import windows as win


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    when: Column
    detail: Column | None = None
    #: a cheap condition, as (column, pattern), without which the rule can't hold; rules share one test
    guard: tuple[str, str] | None = None


def apply(df: DataFrame, rules: list[Rule], *keys: str, spread: int | None = None) -> DataFrame:
    """(keys, rule, severity, detail): one row for each rule that holds on a row.

    Guards are tested once per row, details made for hits only.  Where the table is read by fewer than
    ``spread`` tasks (long texts in one row group), the rows are dealt out to that many first; a table
    that has as many parts is not moved.
    """
    guards = list(dict.fromkeys(r.guard for r in rules if r.guard))
    rows = df.repartition(spread) if spread and df.rdd.getNumPartitions() < spread else df
    rows = rows.withColumns({f"_guard{i}": F.coalesce(F.col(c).rlike(p), F.lit(False)) for i, (c, p) in enumerate(guards)}) if guards else rows
    holds = lambda r: F.col(f"_guard{guards.index(r.guard)}") & r.when if r.guard else r.when
    cell = lambda r: F.when(
        holds(r), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), (r.detail if r.detail is not None else F.lit(None)).cast("string").alias("detail"))
    )
    hits = F.filter(F.array(*[cell(r) for r in rules]), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(hits).alias("hit")).select(*keys, "hit.rule", "hit.severity", "hit.detail")


def union(*issues: DataFrame) -> DataFrame:
    """SET-08."""
    return reduce(DataFrame.unionByName, issues)


# Patterns that mark page headers, page numbers and instructions inside texts.
HEADERS = {
    "code": r"代\s*號\s*[：:]",
    "page_no": r"頁次\s*[:：]?\s*\d",
    "seat": r"座\s*號",
    "level": r"等\s*別\s*[:：]",
    "class": r"類\s*科\s*[:：]",
    "subject": r"科\s*目\s*[:：]",
    "time": r"考試時間\s*[:：]",
    "all_pages": r"全[一二三四五六七八九十\d]+\s*頁",
    "page": r"第\s*\d+\s*頁",
    "of_pages": r"共\s*\d+\s*頁",
    "exam_kind": r"考試別\s*[:：]",
    "turn_over": "請接背面",
    "turn_page": "請翻頁",
    "turn_and_go_on": "請翻面繼續作答",
    "more_papers_behind": "背面尚有試題",
    "more_items_behind": "背面尚有題目",
    "items_are_behind": "背面還有題目",
    "papers_are_behind": "背面還有試題",
    "blank_page": r"以[下上]空白",
    "dashed_page": r"-\s*\d+\s*-",
}
INSTRUCTIONS = {
    "no_copying": "不必抄題",
    "essay_sheet": "申論試卷",
    "no_calculator": "禁止使用電子計算器",
    "calculator": "可以使用電子計算器",
    "pencil": r"2B\s*鉛筆",
    "answered_here": "於本試題上作答者.*不予計分",
    "choose_one": r"請選出一個正確或最適當的?答案",
    "several_chosen": "複選作答者.*該題不予計分",
    "pencil_needed": "須用2B鉛筆",
    "mark_card": "在試卡上依題號清楚劃記",
    "pen": "藍、?黑色鋼筆或原子筆",
    "no_name": "不得於試卷上書寫姓名",
    "ticket": "入場證號",
    "admission": "准考證號碼",
    "single_choice": "本試題為單一選擇題",
    "note": "注意.*[：:]",
    "essay_part": "申論題部分",
    "choice_part": "測驗題部分",
}
# Characters and marks that decoding leaves behind.
ENCODING = {
    "private_use": r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFF}]",
    "control": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
    "replacement": r"[\x{FFFD}\x{FFFE}\x{FFFF}]",
    "compatibility": r"[\x{F900}-\x{FAFF}]{2,}",
    "format": r"[\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}]{2,}",
    "latin1_run": r"[ÃÂ¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿À-ÿ]{2,}",
    "rare_ideographs": r"[\x{20000}-\x{2FA1F}]{2,}",
    "hangul_in_chinese": r"[一-鿿](?s:.*)[\x{AC00}-\x{D7AF}]|[\x{AC00}-\x{D7AF}](?s:.*)[一-鿿]",
    "cid": r"\(cid:\d+\)",
    "entity": r"&(?:[a-z]+|#\d+);",
    "boxes": r"[□■●○◎]{3,}",
}
# Doubtful punctuation.
PUNCTUATION = {
    "commas": "[,，]{2,}",
    "stops": "。{2,}",
    "many_marks": "[？?]{3,}|[！!]{3,}",
    "colons": "[：:]{2,}|[；;]{2,}",
    "bracket_stop": r"[（(][。.]",
    "mixed_stops": "[。！？!?][。！？!?]+",
    "blank_after_mark": r"[一-鿿][，。；：、！？]  +[一-鿿]",
    "list_marks": "、{2,}",
    "wide_blanks": " {3,}",
}
# Question marks that stand for lost formula signs.
MATH = {
    "compare_mark": r"[><]\s*\?|\?\s*[><]",
    "operator_mark": r"[√∫∑∏].*\?",
    "script_mark": r"[A-Za-z]\?[0-9]",
    "fraction_mark": r"\d+\s*/\s*\?|\?\s*/\s*\d+",
}
# Words broken by a blank, one entry for each kind of break, case aside.
SPLIT_WORDS = {
    "tion": r"[a-zA-Z]ti\s+on\b",
    "sion": r"[a-zA-Z]si\s+on\b",
    "ment": r"[a-zA-Z]\s+ment\b(?!\s+(?:of|in|on|is|are|was|were|for|and|the|to|a))",
    "ness": r"[a-zA-Z]\s+ness\b",
    "able": r"[a-zA-Z]{3,}\s+able\b(?!\s+to)",
    "ible": r"[a-zA-Z]{3,}\s+ible\b",
    "ing": r"[a-zA-Z]{3,}i\s+ng\b",
    "ence": r"[a-zA-Z]\s+ence\b",
    "ance": r"[a-zA-Z]\s+ance\b",
    "the": r"\bth\s+e\b",
    "that": r"\bth\s+at\b",
    "this": r"\bth\s+is\b",
    "than": r"\bth\s+an\b",
    "when": r"\bwh\s+en\b",
    "which": r"\bwh\s+ich\b",
    "what": r"\bwh\s+at\b",
    "for": r"\bf\s+or\b",
    "can": r"\bc\s+an\b",
    "with": r"\bw\s+ith\b",
    "tor": r"[a-zA-Z]{3,}t\s+or\b(?!\s+[a-zA-Z])",
    "ther": r"[a-zA-Z]{3,}th\s+er\b",
    "human": r"\b[hHwW]um\s+an\b",
    "woman": r"\b[wW]om\s+an\b",
    "software": r"\bsoftw\s+are\b",
    "taiwan": r"\bTaiw\s+an\b",
}
#: A text without any of these holds no broken word: what stands before the blank is left out.
SPLIT_GUARD = r"(?i)\s(?:on|ment|ness|[ai]ble|ng|[ae]nce|ich|ith|er|are|e|at|is|an|en|or)\b"
#: A text without such a character (beyond the Latin ones) holds no pattern that needs one.
WIDE_GUARD = r"[^\x00-\x{24F}]"
#: Patterns that match texts of Latin characters too.
_NARROW = {
    "dashed_page", "control", "latin1_run", "cid", "entity", "commas", "many_marks", "colons", "bracket_stop", "mixed_stops", "wide_blanks", "mid_mark", "function_word", "open_bracket",
}
# Words glued together.
GLUED_WORDS = {
    "preposition": r"\b(?:of|to|in|on|for|by|at|from|with|and|is|as|was)the\b",
    "verb": r"\b(?:to|can|will|should|would|must|cannot)be\b|\b(?:has|have)been\b|\b(?:do|does)not\b",
    "pronoun": r"\b(?:it|which|that)is\b|\bthere(?:are|is)\b",
    "case_border": r"[a-z]{2,}[A-Z][a-z]{2,}",
    "long_lower": r"\b[a-z]{18,}\b",
    "comma": r"[a-z],[a-z]",
    "stop": r"[a-z]\.[A-Z][a-z]",
}
# Ends of texts that were cut off.
TRUNCATED = {
    "mid_mark": r"[，,；;、]\s*$",
    "function_word": r"(?i)\b(?:and|or|but|the|a|an|of|to|in|for|with|by|from|that|this|is|are|was|were|be|have|has|had|not|can|will)\s*$",
    "particle": r"(?:的|之|與|及|或|在|於|為|是|將|把|被|由|從|對|向|以|而|但|並|且)\s*$",
    "open_bracket": r"[（(「『]\s*$",
    "ordinal": r"第\d+$",
}
_WIDE_PATTERNS = {p for table in (ENCODING, HEADERS, INSTRUCTIONS, PUNCTUATION, TRUNCATED) for k, p in table.items() if k not in _NARROW}
# Residue of the page in essay texts.
ESSAY_RESIDUE = {
    "section": r"乙、測驗題|甲、申論題",
    "code": r"代號[:：]\s*\d",
    "page": r"頁次[:：]\s*\d",
    "kind": r"考\s*試\s*別|類\s*科\s*別|科\s*目|考試時間|座號",
    "note": "※注意",
    "sheets": r"全\s*[一二]\s*張",
    "turn": "背面尚有試題|請接背面",
}
# Words that text recognition breaks, at the blank.
BROKEN_AT = (
    "off icer", "pol ice", "gov ern", "con stitu", "pro tec", "se curi", "in vestiga", "cri minal", "en force", "evi dence", "de fend", "pro secu", "judg ment", "com mittee", "com muni",
    "de partment", "ac cident", "pun ish", "man age", "im portant", "in forma", "or ganiza", "re sponsi", "tech nolo", "ser vice", "na tional", "pub lic", "sys tem", "prob lem", "al though",
    "be cause", "be tween", "be fore", "be lieve", "di ffer", "fol low", "know ledge", "ne cessa", "par ticu", "pre vent", "to gether", "per son", "peo ple", "prac tice", "re ceive", "re cent",
    "in ternation", "ex ample", "ex peri", "ap proach", "ap pear", "ap plic", "ad minis", "an nounce", "au thor", "indi vid", "inde pend", "dis cov", "dis cuss", "dis tri", "sup port",
    "sup pose", "sig nif", "inter est", "edu ca", "pres ident", "envi ron", "devel op", "intro duc", "popula tion", "recog ni", "attrac tion",
)
SUFFIXES = ("tion", "sion", "ment", "ness", "ence", "ance", "able", "ible", "ity", "ous", "ive", "ally")
PLACEHOLDERS = ("[待補]", "_todo")

# Four grammars of answers that different audits accept.
ANSWER_GRAMMARS = {
    "tests": "^(?:[A-D]|送分|C或D)$",
    "deep": "^(?:[A-F]|[A-F]或[A-F]|[A-F]{2,}|[A-F](?:,[A-F])+|[A-F](?:、[A-F])+|送分|一律給分)$",
    "structure": "^(?:[A-E]|送分|[A-E](?:[,、|或][A-E])*|\\*|#)$",
    "letters": "^(?:[A-Ea-e]|[A-E,;、\\s]+|送分)$",
}


def pattern_rules(prefix: str, patterns: dict[str, str], column: str, severity: str, ignore_case: bool = False) -> list[Rule]:
    """A rule per pattern: the column holds it; the detail is the first match."""
    flag = "(?i)" if ignore_case else ""
    guard = lambda p: (column, SPLIT_GUARD) if p in SPLIT_WORDS.values() else (column, WIDE_GUARD) if p in _WIDE_PATTERNS else None
    return [
        Rule(f"{prefix}.{k}", severity, F.coalesce(F.col(column), F.lit("")).rlike(flag + p), F.regexp_extract(column, flag + f"({p})" if not p.startswith("(?i)") else p, 0), guard(p))
        for k, p in patterns.items()
    ]


def text_rules(column: str = "text") -> list[Rule]:
    """DET-05..07, 09..12, 17: rules on any single text."""
    return [
        *pattern_rules("encoding", ENCODING, column, "major"),
        *pattern_rules("header", HEADERS, column, "major"),
        *pattern_rules("instruction", INSTRUCTIONS, column, "major"),
        *pattern_rules("punctuation", PUNCTUATION, column, "minor"),
        *pattern_rules("math", MATH, column, "minor"),
        *pattern_rules("split", SPLIT_WORDS, column, "major", ignore_case=True),
        *pattern_rules("glued", GLUED_WORDS, column, "major"),
        *pattern_rules("truncated", TRUNCATED, column, "minor"),
        Rule("bracket.mixed", "minor", F.col(column).rlike(r"\([A-Da-d]\)") & F.col(column).rlike("（[A-Da-d]）")),
        Rule("bracket.unbalanced", "minor", F.regexp_count(column, F.lit("[（(]")) != F.regexp_count(column, F.lit("[）)]"))),
        Rule("garbage.special", "minor", tx.share(column, r"[^\w\s一-鿿　-〿，。、；：「」（）]") > 0.3),
        Rule("garbage.latin_run", "minor", F.col(column).rlike("[A-Za-z]{10,}") & ~F.col(column).rlike(r"[A-Za-z]+\s+[A-Za-z]+")),
        Rule("garbage.numeric", "minor", F.col(column).rlike(r"^[\d\s.\-]{11,}$")),
    ]


def broken_words(df: DataFrame, column: str, exempt: DataFrame, *keys: str) -> DataFrame:
    """DET-05: (keys, word, suffix): a word and a suffix apart, or a known broken word.

    Words of ``exempt(word)`` stand on their own before a suffix ("are able"); it is an ordinary
    anti join, so the list may be of any size.
    """
    rx = rf"(?i)\b([A-Za-z]{{3,}})\s+({'|'.join(SUFFIXES)})\b"
    found = df.select(*keys, F.explode(F.regexp_extract_all(column, F.lit(rx), F.lit(0))).alias("hit"))
    split = found.select(*keys, F.lower(F.regexp_extract("hit", rx, 1)).alias("word"), F.lower(F.regexp_extract("hit", rx, 2)).alias("suffix")).join(exempt.select("word").distinct(), "word", "left_anti")
    known = "(?i)\\b(" + "|".join(w.replace(" ", "\\s+") for w in BROKEN_AT) + ")"
    listed = df.select(*keys, F.explode(F.regexp_extract_all(column, F.lit(known), F.lit(1))).alias("hit"))
    parts = F.split(F.lower("hit"), r"\s+")
    return split.select(*keys, "word", "suffix").unionByName(listed.select(*keys, parts[0].alias("word"), parts[1].alias("suffix")))


def in_english(text: Column, start: Column, end: Column, reach: int = 40, least: float = 0.3) -> Column:
    """DET-12: whether more than ``least`` of the characters around a span are ASCII letters."""
    low = F.greatest(F.lit(0), start - reach)
    around = F.substring(text, low + 1, end - low + reach)
    return tx.share(around, "[A-Za-z]") > least


def code_in_text(column: str, known: tuple[int, ...] = ()) -> Column:
    """DET-06/18: a five-digit code 10000..20000 or one glued to a letter, not behind its label or before a unit."""
    bare = F.regexp_extract(column, r"(?<!\d)(?<!代號[：:]?\s?)(1\d{4}|20000)(?!\d)(?!年|月|日|人|元|分|時|題|頁|條|款|項|號|次|萬|千|百|億|個)", 1)
    glued = F.regexp_extract(column, r"[A-Za-z一-鿿](\d{5})(?!\d)(?!年|月|日|人|元|分|時|題|頁|條|款|項|號|次|萬|千|百|億|個)", 1)
    found = F.coalesce(F.nullif(bare, F.lit("")), F.nullif(glued, F.lit("")))
    return F.when(found.isNotNull() & ~F.coalesce(found.try_cast("int"), F.lit(0)).isin(*(known or (-1,))), found)


def options_text(options: str = "options") -> Column:
    return F.array_join(F.map_values(options), "\n")


def question_rules() -> list[Rule]:
    """DET-01..04, 07..10, 14, 15, 21: rules on one question (columns of sources.corpus)."""
    choice, essay = F.col("type") == "choice", F.col("type") == "essay"
    stem, answer = F.coalesce(F.col("stem"), F.lit("")), F.coalesce(F.col("answer"), F.lit(""))
    keys = F.coalesce(F.array_sort(F.map_keys("options")), F.array().cast("array<string>"))
    values = F.coalesce(F.map_values("options"), F.array().cast("array<string>"))
    n = F.size(keys)
    letters = F.regexp_extract_all(answer, F.lit("[A-F]"), F.lit(0))
    all_text = F.concat_ws("\n", "stem", "passage", options_text())
    return [
        Rule("type.other", "P1", ~F.coalesce(choice | essay, F.lit(False)), F.col("type")),
        Rule("stem.empty", "P0", tx.blank("stem") & choice),
        Rule("stem.empty_essay", "P0", tx.blank("stem") & essay),
        Rule("stem.empty_without_passage", "P0", tx.blank("stem") & tx.blank("passage") & choice),
        Rule("stem.short", "P2", choice & (F.length(F.trim(stem)) < 5), stem),
        Rule("stem.garbled", "P1", stem.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]{2,}|\x{FFFD}{2,}")),
        Rule("stem.leaks_answer", "P1", choice & stem.rlike(r"答案[:：]\s*[A-D]")),
        Rule("stem.header", "P1", stem.rlike(r"乙、測驗|代號[:：]\s*\d{4}")),
        Rule("stem.holds_options", "P1", choice & (n == 0) & stem.rlike(r"(?s)\(A\).*?\(B\).*?\(C\)")),
        Rule("passage.blank", "P2", F.col("passage").isNotNull() & (F.col("passage") != "") & (F.trim("passage") == "")),
        Rule("options.missing", "P0", choice & (n == 0)),
        Rule("options.not_four", "P1", choice & (keys != F.array(*[F.lit(k) for k in "ABCD"])), F.array_join(keys, "")),
        Rule("options.odd_key", "P1", choice & F.exists(keys, lambda k: ~k.rlike("^[A-F]$"))),
        Rule("options.few", "P2", choice & n.between(1, 3)),
        Rule("options.many", "P2", choice & (n > 4)),
        Rule("options.under_two", "P1", choice & (n < 2)),
        Rule("options.placeholder", "P1", choice & F.exists(values, lambda v: v.isin(*PLACEHOLDERS))),
        Rule("options.blank", "P1", choice & F.exists(values, lambda v: F.coalesce(F.trim(v), F.lit("")) == "")),
        Rule("options.prefixed", "P1", choice & F.exists(values, lambda v: F.trim(v).rlike(r"^[(（][A-D][)）]"))),
        Rule("options.equal", "P1", choice & F.col("note").isNull() & (tx.distinct_options("options") < n)),
        Rule("options.long", "P2", choice & F.exists(values, lambda v: F.length(v) > 200)),
        Rule("options.header", "P1", choice & F.exists(values, lambda v: v.rlike("|".join(HEADERS.values())))),
        Rule("options.instruction", "P1", choice & F.exists(values, lambda v: v.rlike("|".join(INSTRUCTIONS.values())))),
        Rule("answer.missing", "P1", choice & (answer == "")),
        Rule("answer.placeholder", "P1", choice & answer.isin(*PLACEHOLDERS)),
        *[Rule(f"answer.not_{name}", "P2", choice & (answer != "") & ~answer.rlike(g), answer) for name, g in ANSWER_GRAMMARS.items()],
        Rule("answer.not_in_options", "P1", choice & answer.rlike("^[A-F]$") & (n > 0) & ~F.array_contains(keys, answer), answer),
        Rule("answer.letter_not_in_options", "P1", choice & (n > 0) & (F.size(F.array_except(letters, keys)) > 0), answer),
        Rule("essay.residue", "P2", essay & stem.rlike("|".join(ESSAY_RESIDUE.values()))),
        Rule("essay.int_number", "P1", essay & (F.col("number_kind") == "int"), F.col("number")),
        Rule("essay.has_options", "P1", essay & (n > 0)),
        Rule("essay.letter_answer", "P1", essay & answer.rlike("^[A-F]$")),
        Rule("essay.short", "P2", essay & (F.length(F.trim(stem)) < 10)),
        Rule("essay.no_score", "P2", essay & (F.length(stem) > 50) & ~stem.rlike(r"\d+\s*分")),
        Rule("essay.pipe", "P2", essay & stem.rlike(r"\|")),
        Rule("essay.null_section", "P2", essay & F.col("section").isNull()),
        Rule("text.private_use", "P1", all_text.rlike(ENCODING["private_use"])),
        Rule("text.case_border", "P2", all_text.rlike(GLUED_WORDS["case_border"])),
        Rule("text.control", "P1", all_text.rlike(ENCODING["control"])),
        Rule("text.todo", "P1", F.contains(all_text, F.lit("_todo"))),
    ]


def file_rules() -> list[Rule]:
    """DET-02, 04, 08, 09, 13: rules on one paper's metadata."""
    time = F.coalesce(F.col("exam_time"), F.lit(""))
    path_year = F.regexp_extract("path", r"(\d{2,3})年", 1).try_cast("int")
    json_year = F.get_json_object("raw", "$.year").try_cast("int")
    return [
        Rule("metadata.missing", "P2", F.get_json_object("raw", "$.metadata").isNull()),
        Rule("metadata.seat_in_time", "P1", time.rlike("座號|代號|頁次"), time),
        Rule("metadata.time_without_digit", "P2", (time != "") & ~time.rlike(r"\d"), time),
        Rule("metadata.code", "P2", F.col("code").isNotNull() & ~F.col("code").rlike(r"^[A-Z0-9\-]+$|[一-鿿]"), F.col("code")),
        Rule("metadata.year_differs", "P1", path_year != json_year, F.concat_ws("/", path_year.cast("string"), json_year.cast("string"))),
        *[Rule(f"metadata.no_{c}", "P2", tx.blank(c)) for c in ("exam_name", "subject", "category")],
    ]


def paper_issues(files: DataFrame, questions: DataFrame) -> DataFrame:
    """DET-01, 02, 04, 13, 14: rules over all questions of a paper, as (file_id, rule, severity, detail)."""
    issue = lambda df, rule, sev, detail: df.select("file_id", F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), detail.cast("string").alias("detail"))
    choice = questions.where("type = 'choice' and number_int is not null")
    essay = questions.where("type = 'essay'").withColumn("value", F.coalesce(tx.numeral_value("number"), F.col("number_int"))).where("value is not null")
    out = [
        issue(win.missing_numbers(choice, "file_id", "number_int"), "numbers.gap", "P1", F.array_join("missing", ",")),
        issue(win.duplicates(choice, "file_id", "number_int"), "numbers.repeat", "P1", F.col("number_int")),
        issue(win.starts_late(choice, "file_id", "number_int"), "numbers.first", "P2", F.col("first_number")),
        issue(win.missing_numbers(essay, "file_id", "value"), "essay.gap", "P2", F.array_join("missing", ",")),
        issue(win.duplicates(essay, "file_id", "value"), "essay.repeat", "P1", F.col("value")),
        issue(win.order_violations(questions, "file_id", "pos", F.col("type") == "choice", F.col("type") == "essay"), "order.essay_after_choice", "P2", F.col("last_early")),
    ]
    counts = questions.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "choice").alias("n_choice"), F.count_if(F.col("type") == "essay").alias("n_essay"))
    f = files.join(counts, "file_id", "left").fillna(0, ["n", "n_choice", "n_essay"])
    declared = tx.declared_count("notes")
    out.append(
        apply(
            f,
            [
                Rule("questions.none", "P0", F.col("n") == 0),
                Rule("notes.count_differs", "P1", declared.isNotNull() & (declared != F.col("n_choice")), F.concat_ws("/", declared.cast("string"), F.col("n_choice").cast("string"))),
                Rule("notes.promise_essay", "P1", tx.notes_mention_essay("notes") & (F.col("n_essay") == 0)),
                Rule("notes.promise_choice", "P1", tx.notes_mention_choice("notes") & (F.col("n_choice") == 0)),
                Rule("total.differs", "P1", F.get_json_object("raw", "$.total_questions").try_cast("long") != F.col("n")),
            ],
            "file_id",
        )
    )
    return union(*out)


def missing_option_class(stem: str = "stem", section: str = "section") -> Column:
    """DET-19: why a choice question has no options."""
    s = F.col(stem)
    marks = F.size(F.array_distinct(F.regexp_extract_all(s, F.lit(r"[(（]([A-D])[)）]"), F.lit(1))))
    latin = tx.share(s, "[A-Za-z]")
    ask = s.rlike("[?？]")
    return (
        F.when(marks == 4, "ok").when(marks.between(1, 3), "B").when((latin > 0.5) & ~ask, "A")
        .when(((F.length(s) < 80) & ~ask) | F.contains(F.coalesce(F.col(section), F.lit("")), F.lit("申論")), "D").otherwise("C")
    )


def expected_tasks(specs: DataFrame, files: DataFrame, questions: DataFrame) -> DataFrame:
    """DET-20: per spec (category, year, subject, expected array) the numbers its papers lack."""
    seen = questions.groupBy("file_id").agg(F.collect_set("number").alias("seen"))
    on = (F.col("f.category") == F.col("s.category")) & (F.col("f.year") == F.col("s.year")) & F.contains(F.col("f.subject"), F.col("s.subject"))
    j = files.alias("f").join(specs.alias("s"), on).join(seen.alias("q"), F.col("q.file_id") == F.col("f.file_id"), "left")
    missing = F.array_sort(F.array_except("s.expected", F.coalesce("q.seen", F.array().cast("array<string>"))))
    return j.select("s.category", "s.year", "s.subject", "f.file_id", missing.alias("missing")).where(F.size("missing") > 0)


# Keys of a paper's JSON and of its metadata: needed, expected, allowed.
NEEDED_KEYS, EXPECTED_KEYS = ("metadata", "questions"), ("notes", "sections")
ALLOWED_KEYS = ("year", "category", "subject", "level", "original_subject", "source_pdf", "file_type", "total_questions", "exam_name")
NEEDED_METADATA, EXPECTED_METADATA = ("subject",), ("level", "exam_time")


def json_keys(raw: Column, path: str = "$") -> Column:
    """Keys of the object at a path of a JSON text (null where there is none)."""
    return F.json_object_keys(F.get_json_object(raw, path))


def schema_issues(files: DataFrame) -> DataFrame:
    """DET-13: keys that papers lack or have too many of, by level of need, and metadata of odd form."""
    top, meta = F.coalesce(json_keys(F.col("raw")), F.array().cast("array<string>")), F.coalesce(json_keys(F.col("raw"), "$.metadata"), F.array().cast("array<string>"))
    lits = lambda names: F.array(*[F.lit(n) for n in names])
    rows = lambda keys, rule, severity: F.transform(keys, lambda k: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), k.alias("detail")))
    value = lambda k: F.get_json_object("raw", f"$.metadata.{k}")
    is_object = F.coalesce(F.get_json_object("raw", "$.metadata").startswith("{"), F.lit(False))
    empty = F.filter(lits(NEEDED_METADATA), lambda k: F.array_contains(meta, k) & F.coalesce(F.trim(F.element_at(F.create_map(*[x for n in NEEDED_METADATA for x in (F.lit(n), F.coalesce(value(n), F.lit("")))]), k)) == "", F.lit(True)))
    odd = F.array_compact(F.array(F.when(F.array_contains(meta, "exam_type") & ~F.coalesce(value("exam_type").rlike(r"^\d{3}$"), F.lit(False)), F.lit("exam_type"))))
    found = F.concat(
        rows(F.array_except(lits(NEEDED_KEYS), top), "keys.missing", "P0"),
        rows(F.array_except(lits(EXPECTED_KEYS), top), "keys.absent", "P2"),
        rows(F.array_except(top, lits((*NEEDED_KEYS, *EXPECTED_KEYS, *ALLOWED_KEYS))), "keys.extra", "P2"),
        F.when(F.array_contains(top, "metadata") & ~is_object, rows(lits(("metadata",)), "metadata.no_object", "P0")).otherwise(rows(F.array().cast("array<string>"), "", "")),
        F.when(is_object, F.concat(rows(F.array_except(lits(NEEDED_METADATA), meta), "metadata.missing", "P1"), rows(F.array_except(lits(EXPECTED_METADATA), meta), "metadata.absent", "P2"), rows(empty, "metadata.empty", "P1"), rows(odd, "metadata.odd", "P2"))).otherwise(
            rows(F.array().cast("array<string>"), "", "")
        ),
    )
    return files.select("file_id", F.explode(found).alias("i")).select("file_id", "i.*")


def garbled(text: Column) -> Column:
    """DET-21: two or more control or replacement characters in a row."""
    return F.coalesce(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]{2,}|\x{FFFD}{2,}"), F.lit(False))


def residue(text: Column) -> Column:
    """DET-21: names of the page residue that a text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in ESSAY_RESIDUE.items()]))


def site_issues(papers: DataFrame, cards: DataFrame) -> DataFrame:
    """DET-16: counts of papers against counts of rendered cards, presence both ways."""
    a = papers.groupBy("card").agg(F.count("*").alias("n_questions"))
    b = cards.groupBy("card").agg(F.count("*").alias("n_rendered"))
    j = a.join(b, "card", "full")
    return j.select(
        "card", F.when(F.col("n_rendered").isNull(), "not rendered").when(F.col("n_questions").isNull(), "no source").when(F.col("n_questions") != F.col("n_rendered"), "count differs").alias("rule"), "n_questions", "n_rendered"
    ).where("rule is not null")


def site_gaps(questions: DataFrame, pages: DataFrame, on: str) -> DataFrame:
    """DET-16: questions against the text of their page: a stem whose first 40 characters aren't there, an
    answer that isn't, and script markup inside a stem."""
    stem = F.substring(F.regexp_replace("stem", r"\s+", ""), 1, 40)
    text = F.regexp_replace("page", r"\s+", "")
    checks = F.array_compact(
        F.array(
            F.when((stem != "") & ~F.contains(text, stem), F.lit("stem not in page")),
            F.when((F.coalesce("answer", F.lit("")) != "") & ~F.contains(F.col("page"), F.col("answer")), F.lit("answer not in page")),
            F.when(F.col("stem").rlike("(?i)<script|javascript:"), F.lit("script in stem")),
        )
    )
    return questions.join(pages.select(on, "page"), on).select(on, "pos", F.explode(checks).alias("rule"))


def category_coverage(files: DataFrame, expected: DataFrame) -> DataFrame:
    """DET-16: categories that are expected and lack papers, or have papers and aren't expected."""
    have = files.where("category is not null").groupBy("category").agg(F.count("*").alias("papers"))
    j = expected.select("category").distinct().withColumn("known", F.lit(True)).join(have, "category", "full")
    return j.where("known is null or papers is null").select("category", F.when(F.col("papers").isNull(), "no papers").otherwise("not expected").alias("rule"), F.coalesce("papers", F.lit(0)).alias("papers"))
