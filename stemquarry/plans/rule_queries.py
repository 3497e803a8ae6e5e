"""Rules over texts, questions, papers and pages (DET): every rule of a table, on texts that hold it and texts that don't."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..operators import search as so
from ..sources import sinks
from .base import query
from .fixtures import PLAIN_SQL, TEXT_ROWS_SQL, pick, plain, quoted, sql_hits, sql_holds, sql_list, sql_pick, text_rows

MIX = "conv_id * 7 + turn"


def marked(t, samples: list[str]):
    """Every whole text with one of the samples behind it."""
    return text_rows(t).select("conv_id", "turn", F.concat(plain(), F.lit(" "), pick(samples, F.col("conv_id") * 7 + F.col("turn"))).alias("text"))


def sql_marked(samples: list[str]) -> str:
    return f"(select conv_id, turn, {PLAIN_SQL} || ' ' || {sql_pick(samples, MIX)} text from {TEXT_ROWS_SQL})"


def family(name: str, doc: str, tables: list[tuple[str, dict[str, str], str, bool]], samples: list[str], detail: bool) -> None:
    """Register all rules of the tables (prefix, patterns, severity, ignore case) over the samples."""
    rows = [(f"{prefix}.{k}", severity, p, fold) for prefix, patterns, severity, fold in tables for k, p in patterns.items()]
    sql = sql_hits(sql_marked(samples), "conv_id, turn", [(r, s, sql_holds(r, p, "text", fold)) for r, s, p, fold in rows], ", text" if detail else "")
    if detail:
        found = " ".join(f"when '{r}' then regexp_extract(text, {quoted(p if p.startswith('(?i)') else '(' + p + ')')}, 0)" for r, _, p, _ in rows)
        sql = f"select conv_id, turn, rule, severity, case rule {found} end detail from ({sql.replace('select conv_id, turn, hit.rule', 'select conv_id, turn, text, hit.rule', 1)})"

    def run(t):
        made = [r for prefix, patterns, severity, fold in tables for r in rules.pattern_rules(prefix, patterns, "text", severity, ignore_case=fold)]
        out = rules.apply(marked(t, samples), made, "conv_id", "turn")
        return out if detail else out.drop("detail")

    run.__name__, run.__doc__ = name, doc
    query(sql)(run)


family("rule_headers", "DET-05..10: header and page residue.", [("header", rules.HEADERS, "major", False)], [
    "代 號：123", "頁次：3", "座 號", "等 別：三等", "類 科：資訊", "科 目：英文", "考試時間：2小時", "全三頁", "第 3 頁 共 4 頁", "考試別：特考", "請翻頁", "請接背面", "請翻面繼續作答", "背面尚有試題", "背面尚有題目", "背面還有題目", "背面還有試題", "以下空白", "- 12 -",
    "代號", "頁次", "座位", "第三章頁", "全頁", "12", "",
], True)
family("rule_instructions", "DET-10: instructions inside texts.", [("instruction", rules.INSTRUCTIONS, "major", False)], [
    "不必抄題", "申論試卷", "禁止使用電子計算器", "可以使用電子計算器", "2B 鉛筆", "不予計分", "於本試題上作答者，不予計分", "複選作答者，該題不予計分", "須用2B鉛筆", "注意事項：", "申論題部分", "請選出一個正確或最適當的答案", "請選出一個正確或最適當答案", "在試卡上依題號清楚劃記", "藍、黑色鋼筆或原子筆", "藍黑色鋼筆或原子筆",
    "不得於試卷上書寫姓名", "入場證號", "准考證號碼", "本試題為單一選擇題", "注意 ：", "測驗題部分", "2B", "注意", "試卡", "電子計算器", "",
], True)
family("rule_encoding", "DET-05, 06, 11, 12: what decoding leaves behind.", [("encoding", rules.ENCODING, "major", False)], [
    "", "\x01 b", "�", "豈更", "  ", "Ã©", "\U00020000\U00020001", "中文 한국", "한국 文", "(cid:12)", "&amp; x", "&#12;", "□□□", "●○◎",
    "é", "cid:12", "& amp", "□", "한국", "中文", "",
], True)
family("rule_punctuation", "DET-06, 11: doubtful punctuation.", [("punctuation", rules.PUNCTUATION, "minor", False)], [
    ",,", "，,", "。。", "？？？", "!!!", "：:", "；；", "（。", "(.", "！？", "?!", "中，  文", "、、", "a    b", "，", "。", "？", ":", "（文。", "中， 文", "",
], True)
family("rule_math", "DET-06: lost formula signs.", [("math", rules.MATH, "minor", False)], ["> ?", "?<", "√2 ?", "∑ a ? b", "a?2", "3 / ?", "? / 4", "> 3", "√2", "a? 2", "3 / 4", ""], True)
family("rule_truncated", "DET-05, 11: cut-off texts.", [("truncated", rules.TRUNCATED, "minor", False)], [
    "end,", "頓、", "and the", "come of ", "THE", "他的", "於 ", "open (", "（", "「", "第12", "end.", "的話", "第12條", "band", "(a)", "",
], False)
family("rule_english", "DET-05, 06, 12, 17: split and glued English words.", [("split", rules.SPLIT_WORDS, "major", True), ("glued", rules.GLUED_WORDS, "major", False)], [
    "sta ti on", "stati on", "missi on", "govern ment", "govern ment of it", "kind ness", "read able", "read able to", "vis ible", "runni ng", "differ ence", "import ance", "Th e", "th at", "th is", "th an", "wh en", "wh ich", "wh at",
    "f or", "c an", "w ith", "monit or", "monit or x", "togeth er", "hum an", "Wom an", "softw are", "taiw an", "th ex", "ofthe", "canbe", "hasbeen", "donot", "itis", "therearex", "thereis", "fooBar", "x" * 18, "x" * 17, "a,b", "a.Bc", "of the", "a, b", "",
], False)

_ANSWERS = ["A", "B", "E", "F", "AB", "ABG", "A或B", "A,B", "A、B", "A;B", "a", "送分", "一律給分", "*", "#", "C或D", "A | B", "X", "", "A B"]


@query(
    "select answer, count(*) n, "
    + ", ".join(f"bool_and(regexp_matches(answer, {quoted(p)})) \"{k}\"" for k, p in rules.ANSWER_GRAMMARS.items())
    + f" from (select {sql_pick(_ANSWERS, MIX)} answer from conversations union all select unnest(regexp_extract_all(text, '[A-Ga-f*#]+(?:[,;| ]+[A-F])*')) from documents) group by 1"
)
def rule_answer_grammar(t):
    """DET-03: each answer under all four grammars."""
    a = t("conversations").select(pick(_ANSWERS, F.col("conv_id") * 7 + F.col("turn")).alias("answer"))
    a = a.unionByName(t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Ga-f*#]+(?:[,;| ]+[A-F])*"), F.lit(0))).alias("answer")))
    return a.groupBy("answer").agg(F.count("*").alias("n"), *[F.every(F.col("answer").rlike(p)).alias(k) for k, p in rules.ANSWER_GRAMMARS.items()])


_BRACKETS = ["(", "（a)", "(a)", "（b）(c)", ")", "(A)（B）", "(A)(B)", ""]


@query(f"""select conv_id, turn, 'bracket.unbalanced' rule from {sql_marked(_BRACKETS)} where len(regexp_extract_all(text, '[（(]')) <> len(regexp_extract_all(text, '[）)]')) union all
    select conv_id, turn, 'bracket.mixed' from {sql_marked(_BRACKETS)} where regexp_matches(text, '\\([A-Da-d]\\)') and regexp_matches(text, '（[A-Da-d]）')""")
def rule_brackets(t):
    """DET-06/11: unbalanced and mixed brackets."""
    return rules.apply(marked(t, _BRACKETS), [r for r in rules.text_rules() if r.id.startswith("bracket.")], "conv_id", "turn").select("conv_id", "turn", "rule")


def _text_rules_sql() -> list[tuple[str, str, str]]:
    """All rules of text_rules as SQL over a column ``text``."""
    tables = (("encoding", rules.ENCODING, "major", False), ("header", rules.HEADERS, "major", False), ("instruction", rules.INSTRUCTIONS, "major", False), ("punctuation", rules.PUNCTUATION, "minor", False), ("math", rules.MATH, "minor", False), ("split", rules.SPLIT_WORDS, "major", True), ("glued", rules.GLUED_WORDS, "major", False), ("truncated", rules.TRUNCATED, "minor", False))
    special = r"[^\w\s一-鿿　-〿，。、；：「」（）]"
    return [(f"{p}.{k}", s, sql_holds(f"{p}.{k}", x, "text", fold)) for p, patterns, s, fold in tables for k, x in patterns.items()] + [
        ("bracket.mixed", "minor", r"regexp_matches(text, '\([A-Da-d]\)') and regexp_matches(text, '（[A-Da-d]）')"),
        ("bracket.unbalanced", "minor", "len(regexp_extract_all(text, '[（(]')) <> len(regexp_extract_all(text, '[）)]'))"),
        ("garbage.special", "minor", f"length(text) > 0 and len(regexp_extract_all(text, '{special}')) > 0.3 * length(text)"),
        ("garbage.latin_run", "minor", r"regexp_matches(text, '[A-Za-z]{10,}') and not regexp_matches(text, '[A-Za-z]+\s+[A-Za-z]+')"),
        ("garbage.numeric", "minor", r"regexp_matches(text, '^[\d\s.\-]{11,}$')"),
    ]


@query(f"select rule, severity, count(*) n from ({sql_hits('documents', 'doc_id', _text_rules_sql())}) group by 1, 2")
def rule_all_texts(t):
    """DET-05..07, 09..12, 17: every text rule in one pass, counted."""
    docs = t("documents").select("doc_id", "text")
    spread = docs.sparkSession.sparkContext.defaultParallelism  # the table is one row group up to a million rows
    return rules.apply(docs, rules.text_rules(), "doc_id", spread=spread).groupBy("rule", "severity").agg(F.count("*").alias("n"))


_UNIT = "年|月|日|人|元|分|時|題|頁|條|款|項|號|次|萬|千|百|億|個"
_CODES = ["12345", "x 20000", "代號：12345", "12345元", "a12345", "法30501", "法30501條", "123456", "9999", "代號12345", "20001", "10000人 15000", ""]


@query(f"""select conv_id, turn, code from (select conv_id, turn, coalesce(
      nullif(regexp_extract(regexp_replace(text, '代號[：:]?\\s?\\d+', '代號', 'g'), '(?:^|[^\\d])(1\\d{{4}}|20000)(?:$|[^\\d年月日人元分時題頁條款項號次萬千百億個])', 1), ''),
      nullif(regexp_extract(text, '[A-Za-z一-鿿](\\d{{5}})(?:$|[^\\d年月日人元分時題頁條款項號次萬千百億個])', 1), '')) code from {sql_marked(_CODES)}) where code is not null and code <> '15000'""")
def rule_codes(t):
    """DET-06/18: stray codes, but for known ones."""
    return marked(t, _CODES).select("conv_id", "turn", rules.code_in_text("text", (15000,)).alias("code")).where("code is not null")


_BROKEN = ["a pol ice b", "sta tion", "are able", "govern  ment", "in vestiga x", "Judg ment day", "plain text", "ab tion", ""]
_BROKEN_RX = f"(?i)(?:^|[^\\pL\\p{{Nd}}_])([a-z]{{3,}})\\s+({'|'.join(rules.SUFFIXES)})(?:[^\\pL\\p{{Nd}}_]|$)"


#: What parts words is doubled, so that a match leaves the next one its border.
@query(f"""select conv_id, turn, word, suffix from (select conv_id, turn, unnest(list_zip(list_transform(regexp_extract_all(x, {quoted(_BROKEN_RX)}, 1), lambda w: lower(w)), list_transform(regexp_extract_all(x, {quoted(_BROKEN_RX)}, 2), lambda w: lower(w)))) z, z[1] word, z[2] suffix
    from (select conv_id, turn, regexp_replace(text || ' ' || {sql_pick(_BROKEN, MIX)}, '([^\\pL\\p{{Nd}}_])', '\\1\\1', 'g') x from {TEXT_ROWS_SQL})) where word <> 'are'
    union all select conv_id, turn, string_split_regex(lower(h), '\\s+')[1], string_split_regex(lower(h), '\\s+')[2] from (select conv_id, turn,
      unnest(list_filter([regexp_extract(text || ' ' || {sql_pick(_BROKEN, MIX)}, x, 1) for x in {sql_list(['(?i)(?:^|[^a-z])(' + w.replace(' ', chr(92) + 's+') + ')' for w in rules.BROKEN_AT])}], lambda y: y <> '')) h from {TEXT_ROWS_SQL})""")
def rule_broken_words(t):
    """DET-05: known broken words, and suffixes apart from a word that isn't exempt."""
    c = text_rows(t).select("conv_id", "turn", F.concat("text", F.lit(" "), pick(_BROKEN, F.col("conv_id") * 7 + F.col("turn"))).alias("text"))
    exempt = t("conversations").sparkSession.createDataFrame([("are",)], "word string")
    return rules.broken_words(c, "text", exempt, "conv_id", "turn")


_AROUND = ["一二三四五六七八九十X一二三四五六七八九十", "plain English words X around it", "數字 12345678901234567890 X 12345", "ab X 中文字中文字中文字", "X"]


@query(f"""select conv_id, turn, len(regexp_extract_all(a, '[A-Za-z]')) > 0.3 * length(a) english from (select conv_id, turn, substr(text, greatest(0, p - 40) + 1, p + 1 - greatest(0, p - 40) + 40) a
    from (select conv_id, turn, text, strpos(text, 'X') - 1 p from (select conv_id, turn, text || ' ' || {sql_pick(_AROUND, MIX)} text from {TEXT_ROWS_SQL})))""")
def rule_english_context(t):
    """DET-12: whether the surroundings of a span (here the X) are English."""
    c = text_rows(t).select("conv_id", "turn", F.concat("text", F.lit(" "), pick(_AROUND, F.col("conv_id") * 7 + F.col("turn"))).alias("text"))
    at = F.position(F.lit("X"), F.col("text")) - 1
    return c.select("conv_id", "turn", rules.in_english(F.col("text"), at, at + 1).alias("english"))


_GARBLED = ["題目\x01\x02", "a��b", "\x01 a", "座號 12", "※注意：頁次：3", "背面尚有試題", "科 目", "代號：123 乙、測驗題", "plain", ""]


@query(f"""select conv_id, turn, regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]{{2,}}|\\x{{FFFD}}{{2,}}') garbled,
    list_filter([{', '.join(f"case when regexp_matches(text, {quoted(p)}) then '{k}' end" for k, p in rules.ESSAY_RESIDUE.items())}], lambda x: x is not null) residue from {sql_marked(_GARBLED)}""")
def rule_helpers(t):
    """DET-21: garbled texts and page residue by name."""
    return marked(t, _GARBLED).select("conv_id", "turn", rules.garbled(F.col("text")).alias("garbled"), rules.residue(F.col("text")).alias("residue"))


@query("select role, count(*) n, count(*) filter (where length(trim(text)) < 5) short, count(*) filter (where coalesce(trim(text), '') = '') blank from (select role, case turn % 4 when 1 then '' when 2 then ' ' || substr(text, 1, 4) else text end text from conversations) group by 1")
def rule_stems(t):
    """DET-01, 02, 04, 07: short and empty stems."""
    from ..functions import text as tx

    m = F.col("turn") % 4
    c = t("conversations").select("role", F.when(m == 1, "").when(m == 2, F.concat(F.lit(" "), F.substring("text", 1, 4))).otherwise(F.col("text")).alias("text"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) < 5).alias("short"), F.count_if(tx.blank("text")).alias("blank"))


_TRIAGE = ["何者正確？(A)a(B)b(C)c(D)d", "何者正確？（A）a（B）b", "the long passage of english words without any mark", "Which of these?", "短題幹", "長" * 90, "何者？", "x"]
_SECTIONS = [None, "甲、申論題", "乙、測驗題"]


@query(f"""select conv_id, turn, case when marks = 4 then 'ok' when marks between 1 and 3 then 'B' when latin > 0.5 * length(s) and not ask then 'A' when length(s) < 80 and not ask or contains(coalesce(section, ''), '申論') then 'D' else 'C' end kind
    from (select conv_id, turn, s, section, len(list_distinct(regexp_extract_all(s, '[(（]([A-D])[)）]', 1))) marks, len(regexp_extract_all(s, '[A-Za-z]')) latin, regexp_matches(s, '[?？]') ask
    from (select conv_id, turn, case when (conv_id + turn) % 2 = 0 then '' else text || ' ' end || {sql_pick(_TRIAGE, MIX)} s, {sql_pick(_SECTIONS, 'conv_id + turn')} section from {TEXT_ROWS_SQL}))""")
def option_triage(t):
    """DET-19: why choice questions lack options."""
    before = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, "").otherwise(F.concat("text", F.lit(" ")))
    c = text_rows(t).select("conv_id", "turn", F.concat(before, pick(_TRIAGE, F.col("conv_id") * 7 + F.col("turn"))).alias("text"), pick(_SECTIONS, F.col("conv_id") + F.col("turn")).alias("section"))
    return c.select("conv_id", "turn", rules.missing_option_class("text", "section").alias("kind"))


# ---- typed questions ----

_TYPES = ["choice", "choice", "choice", "essay", "other"]
_STEMS = [
    "下列何者為正確的敘述", "", "  ", "abc", "題目\x01\x02內容很長", "答案：A 何者正確", "代號：1234 題目內容在此", "題目 (A) a (B) b (C) c", "某某文字很長的題幹", "fooBar glued stem", "有_todo標記的題幹", "說明題 25 分 " + "說" * 60,
    "長" * 60, "甲|乙 題幹文字說明", "科 目 與座號殘留", " private", "�� garbled stem",
]
_OPTIONS = [
    {"A": "a", "B": "b", "C": "c", "D": "d"}, {}, {"A": "a", "B": "b", "C": "c"}, {"A": "a", "B": "b", "C": "c", "D": "d", "E": "e"}, {"A": "a"}, {"A": "a", "B": "b", "G": "x"}, {"A": "[待補]", "B": "b", "C": "c", "D": "d"},
    {"A": " ", "B": "b", "C": "c", "D": "d"}, {"A": "(A) x", "B": "b", "C": "c", "D": "d"}, {"A": "a", "B": "a ", "C": "c", "D": "d"}, {"A": "長" * 201, "B": "b", "C": "c", "D": "d"}, {"A": "座號", "B": "b", "C": "c", "D": "d"},
    {"A": "2B鉛筆", "B": "b", "C": "c", "D": "d"}, {"A": "caseBorder", "B": "", "C": "_todo", "D": "\x02"},
]
_KEYED = ["", "A", "E", "AB", "A或B", "送分", "X", "_todo", "a", "F", None, "[待補]"]
_PASSAGES = [None, "", "  ", "短文"]
_K = "conv_id * 31 + turn * 7"


def _typed(t):
    """Questions whose every field comes from a list, by number."""
    c, k = t("conversations"), F.col("conv_id") * 31 + F.col("turn") * 7
    maps = F.array(*[F.map_from_arrays(F.array(*map(F.lit, o)).cast("array<string>"), F.array(*map(F.lit, o.values())).cast("array<string>")) for o in _OPTIONS])
    whole = F.col("turn") % 2 == 0
    return c.select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), (F.col("turn") + 1).cast("string").alias("number"), F.when(whole, "int").otherwise("string").alias("number_kind"),
        F.when(whole, F.col("turn") + 1).cast("int").alias("number_int"), pick(_TYPES, F.col("conv_id") + F.col("turn")).alias("type"), pick(_STEMS, k).alias("stem"),
        F.element_at(maps, (F.floor(k / 3) % len(_OPTIONS) + 1).cast("int")).alias("options"), pick(_KEYED, F.floor(k / 5)).alias("answer"), pick(_PASSAGES, F.floor(k / 11)).alias("passage"),
        pick([None, "乙"], F.floor(k / 13)).alias("section"), pick([None, "x"], F.floor(k / 17)).alias("note"),
    )


_TYPED_SQL = f"""(select *, concat_ws(chr(10), stem, passage, array_to_string(vals, chr(10))) body, len(ks) n, coalesce(ans, '') a, regexp_extract_all(coalesce(ans, ''), '[A-F]') letters, type = 'choice' c, type = 'essay' e from (
    select conv_id, turn, case when turn % 2 = 0 then 'int' else 'string' end kind, {sql_pick(_TYPES, 'conv_id + turn')} type, {sql_pick(_STEMS, _K)} stem,
    list_extract([{', '.join(sql_list(list(o)) if o else 'cast([] as varchar[])' for o in _OPTIONS)}], cast((({_K}) // 3) % {len(_OPTIONS)} + 1 as integer)) ks,
    list_extract([{', '.join(sql_list(list(o.values())) if o else 'cast([] as varchar[])' for o in _OPTIONS)}], cast((({_K}) // 3) % {len(_OPTIONS)} + 1 as integer)) vals,
    {sql_pick(_KEYED, f'({_K}) // 5')} ans, {sql_pick(_PASSAGES, f'({_K}) // 11')} passage, {sql_pick([None, '乙'], f'({_K}) // 13')} section, {sql_pick([None, 'x'], f'({_K}) // 17')} note from conversations))"""


def _any(condition: str) -> str:
    return f"len(list_filter(vals, lambda v: {condition})) > 0"


_QUESTION_RULES = [
    ("type.other", "P1", "not (c or e)"), ("stem.empty", "P0", "trim(stem) = '' and c"), ("stem.empty_essay", "P0", "trim(stem) = '' and e"),
    ("stem.empty_without_passage", "P0", "trim(stem) = '' and trim(coalesce(passage, '')) = '' and c"), ("stem.short", "P2", "c and length(trim(stem)) < 5"),
    ("stem.garbled", "P1", r"regexp_matches(stem, '[\x00-\x08\x0b\x0c\x0e-\x1f]{2,}|\x{FFFD}{2,}')"), ("stem.leaks_answer", "P1", r"c and regexp_matches(stem, '答案[:：]\s*[A-D]')"),
    ("stem.header", "P1", r"regexp_matches(stem, '乙、測驗|代號[:：]\s*\d{4}')"), ("stem.holds_options", "P1", r"c and n = 0 and regexp_matches(stem, '(?s)\(A\).*\(B\).*\(C\)')"),
    ("passage.blank", "P2", "passage <> '' and trim(passage) = ''"), ("options.missing", "P0", "c and n = 0"), ("options.not_four", "P1", "c and list_sort(ks) <> ['A', 'B', 'C', 'D']"),
    ("options.odd_key", "P1", "c and len(list_filter(ks, lambda k: not regexp_matches(k, '^[A-F]$'))) > 0"), ("options.few", "P2", "c and n between 1 and 3"), ("options.many", "P2", "c and n > 4"), ("options.under_two", "P1", "c and n < 2"),
    ("options.placeholder", "P1", "c and " + _any("v in ('[待補]', '_todo')")), ("options.blank", "P1", "c and " + _any("trim(v) = ''")), ("options.prefixed", "P1", "c and " + _any("regexp_matches(trim(v), '^[(（][A-D][)）]')")),
    ("options.equal", "P1", "c and note is null and len(list_distinct(list_transform(vals, lambda v: trim(v)))) < n"), ("options.long", "P2", "c and " + _any("length(v) > 200")),
    ("options.header", "P1", "c and " + _any(f"regexp_matches(v, {quoted('|'.join(rules.HEADERS.values()))})")), ("options.instruction", "P1", "c and " + _any(f"regexp_matches(v, {quoted('|'.join(rules.INSTRUCTIONS.values()))})")),
    ("answer.missing", "P1", "c and a = ''"), ("answer.placeholder", "P1", "c and a in ('[待補]', '_todo')"),
    *[(f"answer.not_{k}", "P2", f"c and a <> '' and not regexp_matches(a, {quoted(p)})") for k, p in rules.ANSWER_GRAMMARS.items()],
    ("answer.not_in_options", "P1", "c and regexp_matches(a, '^[A-F]$') and n > 0 and not list_contains(ks, a)"), ("answer.letter_not_in_options", "P1", "c and n > 0 and len(list_filter(letters, lambda x: not list_contains(ks, x))) > 0"),
    ("essay.residue", "P2", f"e and regexp_matches(stem, {quoted('|'.join(rules.ESSAY_RESIDUE.values()))})"), ("essay.int_number", "P1", "e and kind = 'int'"), ("essay.has_options", "P1", "e and n > 0"), ("essay.letter_answer", "P1", "e and regexp_matches(a, '^[A-F]$')"),
    ("essay.short", "P2", "e and length(trim(stem)) < 10"), ("essay.no_score", "P2", r"e and length(stem) > 50 and not regexp_matches(stem, '\d+\s*分')"), ("essay.pipe", "P2", "e and contains(stem, '|')"), ("essay.null_section", "P2", "e and section is null"),
    ("text.private_use", "P1", f"regexp_matches(body, {quoted(rules.ENCODING['private_use'])})"), ("text.case_border", "P2", f"regexp_matches(body, {quoted(rules.GLUED_WORDS['case_border'])})"),
    ("text.control", "P1", f"regexp_matches(body, {quoted(rules.ENCODING['control'])})"), ("text.todo", "P1", "contains(body, '_todo')"),
]


@query(f"select rule, severity, count(*) n from ({sql_hits(_TYPED_SQL, 'conv_id, turn', _QUESTION_RULES)}) group by 1, 2")
def question_issues(t):
    """DET-01..04, 07..10, 14, 15: every question rule over questions with faults of every kind, counted."""
    return so.counts(rules.apply(_typed(t), rules.question_rules(), "file_id", "number"), "rule", "severity")


_NOTES = [["共 3 題", "申論題"], ["2B鉛筆"], [], None, ["共3題"], ["測驗", "作文"]]


def _papers(t):
    """(files, questions) with gaps, repeats, late starts, essays behind choices and notes that don't fit."""
    c = t("conversations")
    k = (F.col("conv_id") * 3 + F.col("turn")) % 7
    numerals = F.array(*[F.lit(x) for x in "一二三四"])
    choice = F.col("role") == "user"
    number = F.floor(F.col("turn") / (1 + F.col("conv_id") % 2)) + 1 + F.col("conv_id") % 3
    q = c.where(k != 5).select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), F.when(choice, "choice").otherwise("essay").alias("type"), F.when(choice, number).cast("int").alias("number_int"),
        F.when(choice, number.cast("string")).otherwise(F.element_at(numerals, ((F.col("turn") + F.col("conv_id")) % 4 + 1).cast("int"))).alias("number"),
    )
    ids = c.select("conv_id").distinct()
    ids = ids.union(ids.where("conv_id % 10 = 0").select(F.col("conv_id") + 1_000_000))
    notes = F.array(*[F.lit(None).cast("array<string>") if n is None else F.array(*map(F.lit, n)).cast("array<string>") for n in _NOTES])
    files = ids.select(
        F.col("conv_id").alias("file_id"), F.element_at(notes, (F.col("conv_id") % len(_NOTES) + 1).cast("int")).alias("notes"),
        F.concat(F.lit('{"total_questions": '), (F.col("conv_id") % 5 + 2).cast("string"), F.lit("}")).alias("raw"),
    )
    return files, q


@query(f"""with q as (select conv_id f, turn pos, role = 'user' c, case when role = 'user' then turn // (1 + conv_id % 2) + 1 + conv_id % 3 else (turn + conv_id) % 4 + 1 end v from conversations where (conv_id * 3 + turn) % 7 <> 5),
    files as (select f, array_to_string(list_extract([{', '.join('cast(null as varchar[])' if n is None else sql_list(n) if n else 'cast([] as varchar[])' for n in _NOTES)}], cast(f % {len(_NOTES)} + 1 as integer)), ' ') notes, f % 5 + 2 total
      from (select distinct conv_id f from conversations union all select distinct conv_id + 1000000 from conversations where conv_id % 10 = 0)),
    s as (select f, c, min(v) lo, max(v) hi, list(distinct v) seen from q group by f, c),
    gaps as (select f, c, array_to_string(list_sort(list_filter(range(lo, hi + 1), lambda x: not list_contains(seen, x))), ',') d from s),
    counts as (select files.f, notes, total, count(q.f) n, count(*) filter (where q.c) nc, count(*) filter (where not q.c) ne from files left join q on files.f = q.f group by all),
    declared as (select *, try_cast(nullif(regexp_extract(notes, '共\\s*(\\d+)\\s*題', 1), '') as integer) d from counts)
    select f file_id, case when c then 'numbers.gap' else 'essay.gap' end rule, case when c then 'P1' else 'P2' end severity, d detail from gaps where d <> ''
    union all select f, case when c then 'numbers.repeat' else 'essay.repeat' end, 'P1', cast(v as varchar) from q group by f, c, v having count(*) > 1
    union all select f, 'numbers.first', 'P2', cast(lo as varchar) from s where c and lo <> 1
    union all select f, 'order.essay_after_choice', 'P2', cast(max(pos) filter (where not c) as varchar) from q group by f having max(pos) filter (where not c) > min(pos) filter (where c)
    union all select f, 'questions.none', 'P0', null from counts where n = 0
    union all select f, 'notes.count_differs', 'P1', d || '/' || nc from declared where d <> nc
    union all select f, 'notes.promise_essay', 'P1', null from counts where regexp_matches(notes, '申論|作文|公文') and ne = 0
    union all select f, 'notes.promise_choice', 'P1', null from counts where regexp_matches(notes, '選擇|測驗|2B|試卡') and nc = 0
    union all select f, 'total.differs', 'P1', null from counts where total <> n""")
def paper_issues(t):
    """DET-01, 02, 04, 13, 14: rules over whole papers."""
    return rules.paper_issues(*_papers(t))


_RAWS = [
    '{"metadata": {"subject": "s", "level": "l", "exam_time": "2"}, "notes": [], "sections": [], "questions": []}', '{"metadata": {"subject": " ", "exam_type": "112"}, "questions": [], "extra": 1}', '{"questions": [], "notes": []}',
    '{"metadata": "text", "questions": []}', '{"metadata": {"exam_type": "x12", "level": "l"}, "notes": [], "year": 1, "odd": 2}', "{}",
]
_RAW_ISSUES = [
    [], [("keys.absent", "P2", "notes"), ("keys.absent", "P2", "sections"), ("keys.extra", "P2", "extra"), ("metadata.absent", "P2", "level"), ("metadata.absent", "P2", "exam_time"), ("metadata.empty", "P1", "subject")],
    [("keys.missing", "P0", "metadata"), ("keys.absent", "P2", "sections")], [("keys.absent", "P2", "notes"), ("keys.absent", "P2", "sections"), ("metadata.no_object", "P0", "metadata")],
    [("keys.missing", "P0", "questions"), ("keys.absent", "P2", "sections"), ("keys.extra", "P2", "odd"), ("metadata.missing", "P1", "subject"), ("metadata.absent", "P2", "exam_time"), ("metadata.odd", "P2", "exam_type")],
    [("keys.missing", "P0", "metadata"), ("keys.missing", "P0", "questions"), ("keys.absent", "P2", "notes"), ("keys.absent", "P2", "sections")],
]


@query("with i(k, rule, severity, detail) as (values " + ", ".join(f"({k}, '{r}', '{s}', '{d}')" for k, rows in enumerate(_RAW_ISSUES) for r, s, d in rows) + f""")
    select page_id file_id, rule, severity, detail from pages join i on page_id % {len(_RAWS)} = k""")
def schema_keys(t):
    """DET-13: keys missing, absent or extra by level of need, and metadata of odd form."""
    return rules.schema_issues(t("pages").select(F.col("page_id").alias("file_id"), pick(_RAWS, F.col("page_id")).alias("raw")))


@query("""with p as (select page_id, html page from pages), q as (select page_id, pos, case pos when 0 then coalesce(nullif(regexp_extract(html, '<p>([^<]*)</p>', 1), ''), 'none at all') when 1 then 'absent stem ' || page_id else '<script>x' end stem,
    case page_id % 3 when 0 then 'zzzz-no' when 1 then substr(html, 1, 5) else '' end answer from pages, (values (0), (1), (2)) v(pos)),
    j as (select q.*, page, regexp_replace(page, '\\s+', '', 'g') flat, substr(regexp_replace(stem, '\\s+', '', 'g'), 1, 40) s from q join p on q.page_id = p.page_id)
    select page_id, pos, 'stem not in page' rule from j where s <> '' and not contains(flat, s) union all select page_id, pos, 'answer not in page' from j where answer <> '' and not contains(page, answer)
    union all select page_id, pos, 'script in stem' from j where regexp_matches(stem, '(?i)<script|javascript:')""")
def site_gaps(t):
    """DET-16: questions whose stem or answer their page lacks, and markup in stems."""
    p = t("pages")
    own = F.regexp_extract("html", "<p>([^<]*)</p>", 1)
    m, pos = F.col("page_id") % 3, F.col("pos")
    q = p.select("page_id", "html", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("pos")).select(
        "page_id", "pos",
        F.when(pos == 0, F.when(own == "", "none at all").otherwise(own)).when(pos == 1, F.concat(F.lit("absent stem "), F.col("page_id").cast("string"))).otherwise("<script>x").alias("stem"),
        F.when(m == 0, "zzzz-no").when(m == 1, F.substring("html", 1, 5)).otherwise("").alias("answer"),
    )
    return rules.site_gaps(q, p.select("page_id", F.col("html").alias("page")), "page_id")


@query("""select coalesce(e.category, h.category) category, case when papers is null then 'no papers' else 'not expected' end rule, coalesce(papers, 0) papers
    from (select distinct 'src' || (doc_id % 30 + 5) category from documents) e full join (select source category, count(*) papers from documents group by 1) h on e.category = h.category where e.category is null or papers is null""")
def category_coverage(t):
    """DET-16: categories without papers and papers without a category."""
    d = t("documents")
    return rules.category_coverage(d.select(F.col("source").alias("category")), d.select(F.concat(F.lit("src"), (F.col("doc_id") % 30 + 5).cast("string")).alias("category")))


@query("""select doc_id, 'short' rule, 'P2' severity from documents where n_chars < 600 union all select doc_id, 'at', 'P2' from documents where text like '%@%'
    union all select doc_id, 'repeat', 'P1' from (select doc_id, row_number() over (partition by md5(text) order by doc_id) n from documents) where n > 1""")
def issue_union(t):
    """SET-08: issues of row rules and of rules over groups together."""
    from ..operators import windows as win

    d = t("documents")
    rows = rules.apply(d, [rules.Rule("short", "P2", F.col("n_chars") < 600), rules.Rule("at", "P2", F.contains("text", F.lit("@")))], "doc_id").drop("detail")
    again = win.repeats(d.select("doc_id", F.lit(0).alias("all"), F.md5(F.col("text").cast("binary")).alias("h")), "all", "h", "doc_id")
    return rules.union(rows, again.select("doc_id", F.lit("repeat").alias("rule"), F.lit("P1").alias("severity")))


_REPORT_SQL = """with i as (select source path, 'short' rule, 'P2' severity, cast(n_chars as varchar) detail from documents where n_chars < 600 union all select source, 'digits', 'P1', regexp_extract(text, '[0-9]{3,}', 0) from documents where regexp_matches(text, '[0-9]{3,}')
    union all select source, 'at', 'P2', 'x' from documents where contains(text, '@')), r as (select *, row_number() over (partition by rule order by path, detail) k from i)"""


def _issues(t):
    d = t("documents").withColumn("path", F.col("source"))
    made = [
        rules.Rule("short", "P2", F.col("n_chars") < 600, F.col("n_chars")), rules.Rule("digits", "P1", F.col("text").rlike("[0-9]{3,}"), F.regexp_extract("text", "([0-9]{3,})", 1)), rules.Rule("at", "P2", F.contains("text", F.lit("@")), F.lit("x")),
    ]
    return rules.apply(d, made, "path")


@query(_REPORT_SQL + """ select to_json({'rule': rule, 'severity': severity, 'n': count(*), 'papers': count(distinct path), 'examples': list({'path': path, 'detail': detail} order by path, detail) filter (where k <= 5)}) as json from r group by rule, severity""")
def issue_reports(t):
    """SNK-06: one JSON row per rule."""
    return sinks.issue_report(_issues(t))


@query(_REPORT_SQL + " select severity || '  ' || rule || '  ' || count(*) line from i group by severity, rule")
def text_report(t):
    """SNK-07: the lines of the plain report."""
    lines = sinks.text_report(_issues(t)).split("\n")[1:]
    return t("documents").sparkSession.createDataFrame([(x,) for x in lines if x], "line string")

