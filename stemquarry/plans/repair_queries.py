"""Repairs, parsers, small text functions and page operators, on cases that each must change and that it must leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..operators import client, compare, options, parsers, repairs, sets
from ..operators import windows as win
from ..sources import corpus, pdftext, sinks, tables
from ..sources.scratch import shared_folder
from ..streaming import watch
from .base import query
from .fixtures import PLAIN_SQL, TEXT_ROWS_SQL, pick, plain, quoted, sql_list, sql_pick, text_rows

MIX = "conv_id * 7 + turn"
_FROM = "from conversations"


def mix():
    return F.col("conv_id") * 7 + F.col("turn")


def texts(t, samples: list, name: str = "text", index=None):
    """Every whole text with a sample behind it."""
    sample = pick(samples, index if index is not None else mix())
    return text_rows(t).select("conv_id", "turn", F.concat("text", F.lit(" "), sample).alias(name))


def sql_texts(samples: list, name: str = "text", index: str = MIX) -> str:
    return f"(select conv_id, turn, text || ' ' || {sql_pick(samples, index)} {name} from {TEXT_ROWS_SQL})"


def fields(t, samples: list, name: str):
    """Fields of rows that hold nothing but a sample."""
    return t("conversations").select("conv_id", "turn", pick(samples, mix()).alias(name))


# ---- options without labels: (stem, page lines, expected stem, expected options, expected subtype) ----

_SPLITS = [
    ("何者正確？(A)甲(B)乙(C)丙(D)丁", None, "何者正確？", ["甲", "乙", "丙", "丁"], None),
    ("the long passage of english words without any mark", None, None, None, "passage_fragment"),
    ("短題幹", None, None, None, "incomplete"),
    ("短題幹", "短題幹如下 (A)一 (B)二 (C)三 (D)四", "短題幹如下", ["一", "二", "三", "四"], None),
    ("何者？(A)a(B)b", "何者？(A)a (B)b (C)c (D)d", "何者？", ["a", "b", "c", "d"], None),
    ("何者？(A)a(B)b", None, None, None, "kept"),
    ("下列何者正確？", "下列何者正確？\n甲乙丙\n丁戊己\n庚辛壬\n癸子丑", "下列何者正確?", ["甲乙丙", "丁戊己", "庚辛壬", "癸子丑"], None),
    ("下列何者正確？", "下列何者正確？\n第一個選項的文字很長很長\n續行一二\n第二個選項文字在此\n第三個選項的文字也很長很長\n接續第三\n第四個選項", "下列何者正確?", ["第一個選項的文字很長很長 續行一二", "第二個選項文字在此", "第三個選項的文字也很長很長 接續第三", "第四個選項"], None),
    ("何者正確？①甲", "何者正確？\n①甲 ②乙 ③丙 ④丁\n③④ ②③ ①③④ ①②③④", "何者正確? 1甲 2乙 3丙 4丁", ["34", "23", "134", "1234"], None),
    ("何者正確？", "何者正確？\n①甲 ②乙 ③丙 ④丁\n12 13", None, None, "incomplete"),
    ("下列何者正確？1甲項 2乙項 3丙項 4丁項 12 13 14 1234", None, "下列何者正確? 1甲項 2乙項 3丙項 4丁項", ["12", "13", "14", "1234"], None),
    ("下列何者正確？1甲項 2乙項 3丙項 4丁項", None, "下列何者正確?", ["甲項", "乙項", "丙項", "丁項"], None),
    ("何者正確？甲一  乙二  丙三  丁四", None, "何者正確?", ["甲一", "乙二", "丙三", "丁四"], None),
    ("應如何處理？處其管理權人罰鍰一萬元 處其管理權人罰鍰二萬元 處其管理權人罰鍰三萬元 處其管理權人罰鍰四萬元", None, "應如何處理?", ["處其管理權人罰鍰一萬元", "處其管理權人罰鍰二萬元", "處其管理權人罰鍰三萬元", "處其管理權人罰鍰四萬元"], None),
    ("依規定為何？第一種情形 第一種其他 第一種例外 交通事故", None, "依規定為何?", ["第一種情形", "第一種其他", "第一種例外", "交通事故"], None),
    ("使用何種方法？微粒子試劑（small） 粉末法（powder） 噴霧法（spray） 浸泡法（dip）", None, "使用何種方法?", ["微粒子試劑(small)", "粉末法(powder)", "噴霧法(spray)", "浸泡法(dip)"], None),
    ("正確順序為何？312:甲乙 321:丙丁 123:戊己 132:庚辛", None, "正確順序為何?", ["312:甲乙", "321:丙丁", "123:戊己", "132:庚辛"], None),
    ("下列公式何者正確？2a, 2b, 2c x, y, z 3a, 3b, 3c u, v, w", None, "下列公式何者正確?", ["2a, 2b,", "2c x, y,", "z 3a, 3b,", "3c u, v, w"], None),
    ("應有幾名？5名 6名 7名 8名", None, "應有幾名?", ["5名", "6名", "7名", "8名"], None),
    ("敘述為何？一二三 四五 六七八九 十一二 三四五 六七", None, "敘述為何?", ["一二三 四五", "六七八九", "十一二", "三四五 六七"], None),
    ("下列何者？其中須有半數。 5名 6名 7名 8名", None, "下列何者? 其中須有半數。", ["5名", "6名", "7名", "8名"], None),
    ("何者正確？", None, None, None, "incomplete"),
]


@query(f"""select conv_id, turn, {sql_pick([s if e is None else e for s, _, e, _, _ in _SPLITS], MIX)} stem,
    list_extract([{', '.join('cast(null as varchar[])' if o is None else sql_list(o) for *_, o, _ in _SPLITS)}], cast(({MIX}) % {len(_SPLITS)} + 1 as integer)) options, {sql_pick([s for *_, s in _SPLITS], MIX)} subtype {_FROM}""")
def unlabelled_options(t):
    """REP-02..06: every way in which options without labels are found, and questions that have none."""
    c = t("conversations").select(
        "conv_id", "turn", F.lit("choice").alias("type"), pick([s[0] for s in _SPLITS], mix()).alias("stem"), pick([s[1] for s in _SPLITS], mix()).alias("page"),
        F.lit(None).cast("map<string,string>").alias("options"), F.lit(None).cast("string").alias("section"), F.lit("kept").alias("subtype"),
    )
    return options.repaired(c).select("conv_id", "turn", "stem", F.map_values("options").alias("options"), "subtype")


_LABELLED = ["題目 (A) 甲 (B) 乙 (C) 丙 (D) 丁", "題目 （A）甲（B）乙（C）丙", "前 (A) 句 (B) 題目 (A) 甲 (B) 乙 (C) 丙", "題目 (A) 甲 (C) 乙 (D) 丙", "題目 (B) 甲", "題目"]
_LABELLED_OUT = [["甲", "乙", "丙", "丁"], ["甲", "乙", "丙"], ["甲", "乙", "丙"], None, None, None]


@query(f"select conv_id, turn, list_extract([{', '.join('cast(null as varchar[])' if o is None else sql_list(o) for o in _LABELLED_OUT)}], cast(({MIX}) % {len(_LABELLED)} + 1 as integer)) options {_FROM}")
def split_options(t):
    """REP-01: labelled options out of a stem, from the last A on, if the labels run."""
    return fields(t, _LABELLED, "m").select("conv_id", "turn", F.map_values(repairs.labelled_options(F.col("m"))).alias("options"))


@query("select doc_id, k, case when answer in ('*', '#') then '送分' else answer end answer from (select doc_id, unnest(range(0, len(x))) k, unnest(x) answer from (select doc_id, regexp_extract_all(text, '[*#A-D]') x from documents))")
def star_answers(t):
    """REP-10: every mark and letter of the texts as an answer."""
    answers = t("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[*#A-D]"), F.lit(0))).alias("k", "answer"))
    return repairs.star_answers(answers)


_MAPS = [{"A": "a", "B": "b", "C": "c", "D": "d"}, {"A": "a", "B": " ", "C": "c", "D": "d"}, {"A": "a", "B": "", "C": "", "D": "d"}, {"C": "c", "A": "a"}, {"A": "x", "B": "x ", "C": "y"}, {"A": "a"}, {"B": "b", "A": "", "C": "c", "D": "d", "E": ""}]
_GIVEN = ["A", "D", "E", "送分", "", "AB", "X"]


def maps(t, index=None):
    every = F.array(*[F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*map(F.lit, m.values()))) for m in _MAPS])
    own = F.element_at(every, ((index if index is not None else mix()) % len(_MAPS) + 1).cast("int"))
    return text_rows(t).withColumn("o", F.transform_values(own, lambda k, v: F.when(F.trim(v) == "", v).otherwise(F.concat(F.substring("text", 1, 6), v))))


_MAPS_SQL = f"""(select conv_id, turn, text, list_extract([{', '.join(sql_list(list(m)) for m in _MAPS)}], cast(({MIX}) % {len(_MAPS)} + 1 as integer)) ks,
    list_transform(list_extract([{', '.join(sql_list(list(m.values())) for m in _MAPS)}], cast(({MIX}) % {len(_MAPS)} + 1 as integer)), lambda v: case when trim(v) = '' then v else substr(text, 1, 6) || v end) vs, {sql_pick(_GIVEN, 'conv_id * 3 + turn')} a from {TEXT_ROWS_SQL})"""


@query(f"""select conv_id, turn, case when len(list_filter(vs, lambda v: trim(v) <> '')) >= 3 then list_filter(vs, lambda v: trim(v) <> '') else vs end kept, len(list_distinct(list_transform(vs, lambda v: trim(v)))) distinct_values from {_MAPS_SQL}""")
def option_maps(t):
    """MAP-01/03: empty options go where three others remain; distinct values."""
    return maps(t).select("conv_id", "turn", F.map_values(tx.drop_empty_options("o")).alias("kept"), tx.distinct_options("o").alias("distinct_values"))


@query(f"select conv_id, turn, list_sort(case when regexp_matches(a, '^[A-F]$') and not list_contains(ks, a) then list_append(ks, a) else ks end) as keys from {_MAPS_SQL}")
def missing_answer_keys(t):
    """MAP-02, ORD-07: an answer that is no key is added, keys in order."""
    c = maps(t).withColumn("a", pick(_GIVEN, F.col("conv_id") * 3 + F.col("turn")))
    return c.select("conv_id", "turn", F.map_keys(tx.with_missing_answer("o", "a")).alias("keys"))


_ANSWERS = ["A", "A或C", "B,D", "送分", "", "abC", "A、B、F", "G"]


@query(f"select conv_id, turn, regexp_extract_all(a, '[A-F]') letters from {sql_texts(_ANSWERS, 'a')}")
def answer_letters(t):
    """ARR-01."""
    return texts(t, _ANSWERS, "a").select("conv_id", "turn", tx.answer_letters("a").alias("letters"))


_NOISE = ["題目 - 、", "題目 - -", "題目、", "題目 ;", "題目 -12-", "題目 7", "題目 第 3 頁", "共 4 頁 題目", "題目 請接背面 之後", "2小時 座 號：12", "座號：", "2小時", "題目 | ", "題目||", "a|b", "", "題目 123"]


@query(f"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?:\\s*-\\s*[、-]?)+\\s*$', ''), '\\s*[、,;；]\\s*$', ''), '\\s+-?\\d{{1,2}}-?\\s*$', '') noise,
    regexp_replace(regexp_replace(text, '第\\s*\\d+\\s*頁|共\\s*\\d+\\s*頁|全[一二三四五六七八九十]+頁', '', 'g'), '(?s)(?:請接背面|請以背面|背面尚有試題).*$', '') residue,
    trim(regexp_replace(text, '(?s)\\s*座\\s*號.*$', '')) exam_time, rtrim(regexp_replace(text, '[|\\s]+$', '')) unpiped from {sql_texts(_NOISE)}""")
def trailing_noise(t):
    """TXT-12..15: noise, page residue, seat numbers and pipes."""
    return texts(t, _NOISE).select("conv_id", "turn", tx.strip_trailing_noise("text").alias("noise"), tx.strip_page_residue("text").alias("residue"), tx.clean_exam_time("text").alias("exam_time"), tx.strip_trailing_pipe("text").alias("unpiped"))


_NOTES = ["申論題二題", "作文", "公文", "選擇題", "測驗題", "2B鉛筆", "試卡", "無", "申論與測驗", "", "共 3 題", "共12題", "共題", "本科目共 50 題，每題 2 分"]


@query(f"select conv_id, turn, regexp_matches(n, '申論|作文|公文') essay, regexp_matches(n, '選擇|測驗|2B|試卡') choice from (select conv_id, turn, a || ' ' || b n from (select conv_id, turn, a, {sql_pick(_NOTES[7:], 'conv_id + turn')} b from {sql_texts(_NOTES, 'a')}))")
def note_mentions(t):
    """TXT-27."""
    n = F.array("a", "b")
    c = texts(t, _NOTES, "a").withColumn("b", pick(_NOTES[7:], F.col("conv_id") + F.col("turn")))
    return c.select("conv_id", "turn", tx.notes_mention_essay(n).alias("essay"), tx.notes_mention_choice(n).alias("choice"))


@query(f"select conv_id, turn, try_cast(nullif(regexp_extract(a || ' ' || b, '共\\s*(\\d+)\\s*題', 1), '') as integer) declared from (select conv_id, turn, a, {sql_pick(_NOTES[9:], 'conv_id + turn')} b from {sql_texts(_NOTES, 'a')})")
def declared_counts(t):
    """TXT-26."""
    c = texts(t, _NOTES, "a").withColumn("b", pick(_NOTES[9:], F.col("conv_id") + F.col("turn")))
    return c.select("conv_id", "turn", tx.declared_count(F.array("a", "b")).alias("declared"))


_NUMERALS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十", "二十一", "百", "1", ""]


@query(f"select conv_id, turn, case when i < 20 then i + 1 end v from (select conv_id, turn, cast(({MIX}) % {len(_NUMERALS)} as integer) i {_FROM})")
def numeral_values(t):
    """TXT-25: 1 to 20, and what is none of them."""
    return fields(t, _NUMERALS, "n").select("conv_id", "turn", tx.numeral_value("n").alias("v"))


_SPACED = ["中 文　字", "中  文 a 字", "a 中", "中 1 文", "一 二 三 四 五", "plain text", "中\n文"]


@query(f"select conv_id, turn, regexp_replace(regexp_replace(text, '([一-鿿])[\\s\\x{{3000}}]+([一-鿿])', '\\1\\2', 'g'), '([一-鿿])[\\s\\x{{3000}}]+([一-鿿])', '\\1\\2', 'g') collapsed from (select conv_id, turn, text || {sql_pick(_SPACED, MIX)} || turn text from {TEXT_ROWS_SQL})")
def collapsed_cjk(t):
    """TXT-03."""
    c = text_rows(t).select("conv_id", "turn", F.concat("text", pick(_SPACED, mix()), F.col("turn").cast("string")).alias("text"))
    return c.select("conv_id", "turn", tx.collapse_spaced_cjk("text").alias("collapsed"))


_PHRASES = [("th at", "that"), ("that is", "that's"), ("in to", "into"), ("人 民", "人民"), ("a  b", "ab"), ("'", "’")]
_PHRASED = ["th at is", "in to the", "人 民 a  b", "that’s in'", "nothing", "th  at", ""]


def _replaced(text: str) -> str:
    for a, b in _PHRASES:
        text = f"replace({text}, {quoted(a)}, {quoted(b)})"
    return text


@query(f"select conv_id, turn, {_replaced('text')} fixed from (select conv_id, turn, {PLAIN_SQL} || {sql_pick(_PHRASED, MIX)} text from {TEXT_ROWS_SQL})")
def literal_table(t):
    """TXT-21, REP-18: an ordered table of literal replacements, where later ones see what earlier ones made."""
    c = text_rows(t).select("conv_id", "turn", F.concat(plain(), pick(_PHRASED, mix())).alias("text"))
    return c.select("conv_id", "turn", tx.fold_literal("text", _PHRASES).alias("fixed"))


_PRIVATE = {"": "(A)", "": "(B)", "": "(C)", "": "(D)", "": "①"}
_SIMPLE = dict(zip("国学会实验", "國學會實驗", strict=True))
_CODED = ["甲乙", "國学會", "实验国", "x", "", "plain", "", ""]


@query(f"""select conv_id, turn, regexp_replace({"".join("replace(" for _ in _PRIVATE)}text{"".join(f", '{a}', '{b}')" for a, b in _PRIVATE.items())}, '[\\x{{E000}}-\\x{{F8FF}}]', '', 'g') mapped,
    translate(text, '{"".join(_SIMPLE)}', '{"".join(_SIMPLE.values())}') folded from {sql_texts(_CODED)}""")
def character_map(t):
    """TXT-07/09: private-use marks by table (others go), simplified characters one to one."""
    return texts(t, _CODED).select("conv_id", "turn", tx.replace_private_use("text", _PRIVATE).alias("mapped"), tx.to_traditional("text", _SIMPLE).alias("folded"))


@query("""select conv_id, list_transform(list_reduce(list_transform(spans[2:], lambda s: [s]), lambda acc, s: case when s[1].s >= acc[len(acc)].e then list_concat(acc, s) else acc end, spans[1:1]), lambda s: s.s || ':' || s.e) kept
    from (select conv_id, list_sort(list({'s': (conv_id * 3 + turn * 5) % 20, 'e': (conv_id * 3 + turn * 5) % 20 + turn % 4 + 1})) spans from conversations group by conv_id)""")
def suppressed_spans(t):
    """SET-06: of overlapping or equal spans the first stays."""
    start = (F.col("conv_id") * 3 + F.col("turn") * 5) % 20
    s = t("conversations").select("conv_id", F.struct(start.alias("start"), (start + F.col("turn") % 4 + 1).alias("end")).alias("s")).groupBy("conv_id").agg(F.collect_list("s").alias("spans"))
    return s.select("conv_id", F.transform(sets.suppress_overlaps(F.col("spans")), lambda x: F.concat_ws(":", x["start"], x["end"])).alias("kept"))


_PASSAGE = [None, "", "p"]


@query(f"""select conv_id, turn, case when type = 'choice' and (n < 2 or blank * 2 > n or trim(stem) = '' and trim(coalesce(passage, '')) = '' or n = 0 and turn > 80) then 'deleted' else 'kept' end fate
    from (select conv_id, turn, case when (conv_id + turn) % 5 = 4 then 'essay' else 'choice' end type, len(vs) n, len(list_filter(vs, lambda v: trim(v) = '')) blank, case turn % 3 when 1 then ' ' else text end stem, {sql_pick(_PASSAGE, 'conv_id + turn')} passage from {_MAPS_SQL})""")
def deleted_rows(t):
    """REP-09, FIL-09/12: unusable questions go to a side table."""
    q = maps(t).select(
        "conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, "essay").otherwise("choice").alias("type"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("stem"),
        pick(_PASSAGE, F.col("conv_id") + F.col("turn")).alias("passage"), F.col("turn").cast("int").alias("number_int"), F.col("o").alias("options"),
    )
    kept, deleted = repairs.drop_unusable(q)
    return kept.select("conv_id", "turn", F.lit("kept").alias("fate")).union(deleted.select("conv_id", "turn", F.lit("deleted")))


@query("""with q as (select conv_id, turn n, case when turn = conv_id % 4 then 'last 請依下文回答第 ' || turn + 1 || ' 題至第 ' || turn + 1 + conv_id % 3 || ' 題 long text ' || conv_id else 'last' end leak, case when turn % 5 = 4 then 'own' end own from conversations),
    r as (select conv_id, 'long text ' || conv_id p, conv_id % 4 + 1 lo, conv_id % 4 + 1 + conv_id % 3 hi from q where leak <> 'last')
    select q.conv_id, n number, coalesce(own, p) passage, split_part(leak, ' ', 1) last_option from q left join r on q.conv_id = r.conv_id and n between lo and hi""")
def moved_passages(t):
    """REP-07, JOI-08: a passage in a last option goes to the questions of its range, which keep their own."""
    first = F.col("turn") + 1
    text = F.format_string("last 請依下文回答第 %d 題至第 %d 題 long text %d", first.cast("int"), (first + F.col("conv_id") % 3).cast("int"), F.col("conv_id").cast("int"))
    leak = F.when(F.col("turn") == F.col("conv_id") % 4, text).otherwise("last")
    q = t("conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").cast("int").alias("number_int"), F.create_map(F.lit("A"), F.lit("a"), F.lit("D"), leak).alias("options"), F.when(F.col("turn") % 5 == 4, "own").alias("passage"))
    return repairs.move_passages(q).select(F.col("file_id").alias("conv_id"), F.col("number_int").alias("number"), "passage", F.col("options")["D"].alias("last_option"))


@query("""select conv_id, turn, case when role = 'user' and trim(case turn % 3 when 1 then ' ' else text end) = '' and conv_id % 2 = 0 then '(見文章第 ' || turn || ' 題空格)' else case turn % 3 when 1 then ' ' else text end end stem from conversations""")
def filled_stems(t):
    """REP-08: empty stems of choice questions with a passage."""
    c = t("conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "choice").otherwise("essay").alias("type"), F.col("turn").alias("number"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("stem"),
        F.when(F.col("conv_id") % 2 == 0, "p").otherwise(" ").alias("passage"),
    )
    return repairs.fill_stems(c).select("conv_id", "turn", "stem")


@query("select event_id, ms % 7200000 < 3600000 valid from (select event_id, event_id * 977 + 3599990 ms from events)")
def session_valid(t):
    """DAT-02: sessions of up to two hours, around the limit of one."""
    now = F.col("event_id") * 977 + 3_599_990
    return t("events").select("event_id", tx.session_valid(now - now % 7_200_000, now).alias("valid"))


_FACETS = [None, "", " ", "given"]
_TIMES = ["2小時", "2小時 座號：1", None, "座 號"]


@query(f"""select conv_id, turn, case when trim(coalesce(s, '')) = '' then 'sub' || turn else s end subject, case when trim(coalesce(c, '')) = '' then 'cat' || conv_id % 5 else c end category, trim(regexp_replace(x, '(?s)\\s*座\\s*號.*$', '')) exam_time
    from (select conv_id, turn, {sql_pick(_FACETS, MIX)} s, {sql_pick(_FACETS, 'conv_id + turn')} c, {sql_pick(_TIMES, 'conv_id * 3 + turn')} x {_FROM})""")
def completed_metadata(t):
    """REP-13: absent facets come from the path, given ones stay."""
    path = F.format_string("/c/cat%d/112年/sub%d/試題.json", (F.col("conv_id") % 5).cast("int"), F.col("turn").cast("int"))
    f = fields(t, _FACETS, "subject").withColumns({"category": pick(_FACETS, F.col("conv_id") + F.col("turn")), "exam_time": pick(_TIMES, F.col("conv_id") * 3 + F.col("turn")), "path": path})
    return repairs.complete_metadata(f).select("conv_id", "turn", "subject", "category", "exam_time")


@query(f"""select conv_id, turn, case when type = 'essay' and turn % 2 = 0 and n >= 2 then 'choice' when type = 'choice' and n < 2 and trim(stem) <> '' then 'essay' else type end type
    from (select conv_id, turn, len(vs) n, case when (conv_id + turn) % 3 = 0 then 'essay' else 'choice' end type, case turn % 4 when 3 then ' ' else text end stem from {_MAPS_SQL})""")
def retyped(t):
    """REP-11: types that contradict numbers and options are changed."""
    q = maps(t).select(
        "conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "essay").otherwise("choice").alias("type"), F.when(F.col("turn") % 2 == 0, "int").otherwise("string").alias("number_kind"),
        F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")).alias("stem"), F.col("o").alias("options"),
    )
    return repairs.retype(q).select("conv_id", "turn", "type")


@query("""select conv_id, turn, level from (select c.conv_id, c.turn, h.p, c.text, length(h.p) n, greatest(3, length(h.p) // 5) k, greatest(1, least(15, length(h.p) // 2)) z from conversations c
    join (select conv_id, case conv_id % 4 when 0 then substr(text, 5, 12) when 1 then 'xxx' || substr(text, 5, 14) || 'yyy' when 2 then substr(text, 1, 60) || 'qqqq' else 'absent phrase' end p from conversations where turn = 0) h on c.conv_id = h.conv_id) x,
    lateral (select case when contains(text, p) then 1 when n - 2 * k > 0 and contains(text, substr(p, k + 1, n - 2 * k)) then 2
      when len(list_filter(range(0, greatest(1, n // z)), lambda i: contains(text, substr(p, cast(i * z + 1 as integer), cast(z as integer))))) >= 0.6 * greatest(1, n // z) then 3 else 0 end level) y""")
def containment_levels(t):
    """TXT-33, CMP-05: whole phrases, their cores, their chunks, and phrases that aren't there."""
    c, m = t("conversations"), F.col("conv_id") % 4
    p = F.when(m == 0, F.substring("text", 5, 12)).when(m == 1, F.concat(F.lit("xxx"), F.substring("text", 5, 14), F.lit("yyy"))).when(m == 2, F.concat(F.substring("text", 1, 60), F.lit("qqqq"))).otherwise("absent phrase")
    heads = c.where("turn = 0").select("conv_id", p.alias("p"))
    return compare.coverage(heads, c.select("conv_id", "turn", "text"), "conv_id", "p", "text").select("conv_id", "turn", "level")


_SELECTS = [
    '<select><option value="">all</option><option value="5">exam 5</option></select>', '<option selected value="7" class="x"> exam seven </option>', '<option value="9">other</option>', "<p>exam</p>", "",
]


@query(f"""select page_id, value, label from (select page_id, regexp_extract(o, 'value="([^"]*)"', 1) value, trim(regexp_extract(o, '>([^<]*)$', 1)) label from (select page_id, unnest(regexp_extract_all(html, '<option[^>]*value="[^"]*"[^>]*>[^<]*')) o
    from (select page_id, html || {sql_pick(_SELECTS, 'page_id')} html from pages))) where value <> '' and contains(label, 'exam')""")
def listing_options(t):
    """SRC-14: options of a listing page whose label holds a keyword."""
    p = t("pages").select("page_id", F.concat("html", pick(_SELECTS, F.col("page_id"))).alias("html"))
    return tables.exam_options(p, "html", "exam", "page_id")


_LISTINGS = [
    '<a href="wHandExamQandA_File.ashx?t=Q&amp;code=112&amp;c=301">a</a><a href="f.ashx?t=S&c=301">b</a>', '<a href="f.ashx?c=7&amp;t=M">x</a><a href="g.html">y</a>', '<a href="f.ashx?t=R&c=8">r</a><a href="f.ashx?t=X&c=9">no</a>', "<a>none</a>", "",
]


@query(f"""select page_id, regexp_extract(href, '[?&;]c=(\\w+)', 1) code, case regexp_extract(href, '[?&;]t=([QSMR])', 1) when 'Q' then 'question' when 'S' then 'answer' when 'M' then 'correction' else 'reference' end kind, href
    from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href from (select page_id, html || {sql_pick(_LISTINGS, 'page_id')} html from pages)) where regexp_matches(href, '[?&](?:amp;)?t=[QSMR]')""")
def listing_links(t):
    """SRC-15: file links with code and kind."""
    return tables.download_links(t("pages").select("page_id", F.concat("html", pick(_LISTINGS, F.col("page_id"))).alias("html")), "html", "page_id")


@query("""with a as (select page_id, n, case when n < page_id % 7 then 'timeout' end error, case page_id % 5 when 0 then 'text/html' when 1 then 'application/octet-stream' else 'application/PDF' end kind, case page_id % 3 when 0 then 900 else 2000 + page_id end size from pages, range(6) r(n) where n <= page_id % 7),
    f as (select page_id, min(n) filter (where error is null and n < 5) ok, least(max(n) + 1, 5) tried, any_value(kind) kind, any_value(size) size from a group by 1)
    select page_id, case when page_id % 11 = 0 then 'skipped' when ok is null then 'failed' when kind = 'text/html' then 'wrong type' when size <= 1024 then 'too small' else 'done' end status,
      cast(case when page_id % 11 = 0 then 0 else coalesce(ok + 1, tried) end as integer) attempts, cast(case when page_id % 11 = 0 then 0 else 2 ** coalesce(ok, tried - 1) - 1 end as bigint) waited,
      case when page_id % 11 = 0 then 5000 when ok is not null and kind <> 'text/html' and size > 1024 then size end size from f""")
def download_status(t):
    """SRC-16: what came of each download over its attempts."""
    p = t("pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt")).where("attempt <= page_id % 7")
    m = F.col("page_id") % 5
    a = p.select(
        F.col("page_id").alias("key"), "attempt", F.when(F.col("attempt") < F.col("page_id") % 7, "timeout").alias("error"), F.when(m == 0, "text/html").when(m == 1, "application/octet-stream").otherwise("application/PDF").alias("content_type"),
        F.when(F.col("page_id") % 3 == 0, 900).otherwise(2000 + F.col("page_id")).cast("long").alias("size"),
    )
    cached = t("pages").select(F.col("page_id").alias("key"), F.when(F.col("page_id") % 11 == 0, 5000).otherwise(500).cast("long").alias("size")).where("key % 11 = 0 or key % 13 = 0")
    return tables.download_status(a, cached).join(t("pages").select(F.col("page_id").alias("key")), "key").withColumnRenamed("key", "page_id")


# ---- sequences and texts ----


@query("""select conv_id, role, list_reduce(list(v order by turn), lambda acc, x: case when contains(acc, x) then acc else acc || chr(10) || x end) as text from (select conv_id, role, turn, case turn % 3 when 2 then substr(text, 1, 3) else text end v from conversations) group by conv_id, role""")
def merged_texts(t):
    """WIN-08: texts of one key, but those that are contained already."""
    c = t("conversations").withColumn("text", F.when(F.col("turn") % 3 == 2, F.substring("text", 1, 3)).otherwise(F.col("text")))
    return win.merge_texts(c, ["conv_id", "role"], "text", "turn")


_BREAKS = ["sta ti on", "stati on x", "missi on", "th at th is", "th e", "th ey th eir", "wh ich", "f or f rom", "in to", "monit or", "comm on reas on", "th atx", "xth e", "hum an pers on pris on", ""]


@query("select conv_id, turn, " + "".join("regexp_replace(" for _ in tx.BROKEN_WORDS) + "text" + "".join(f", {quoted(p.replace('(?U)', ''))}, {quoted(r.replace('$1', chr(92) + '1'))}, 'g')" for p, r in tx.BROKEN_WORDS) + f" fixed from (select conv_id, turn, {PLAIN_SQL} || ' ' || {sql_pick(_BREAKS, MIX)} text from {TEXT_ROWS_SQL})")
def broken_words(t):
    """TXT-01/02: ordered repairs of split words."""
    c = text_rows(t).select("conv_id", "turn", F.concat(plain(), F.lit(" "), pick(_BREAKS, mix())).alias("text"))
    return c.select("conv_id", "turn", tx.repair_broken_words("text").alias("fixed"))


@query("""select doc_id, cast(start as integer) "start", cast(start + length(m) as integer) "end", m "text" from (select doc_id, unnest(ms) m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) as start
    from (select doc_id, regexp_extract_all(text, '[A-Z][a-z]+\\.') ms, string_split_regex(text, '[A-Z][a-z]+\\.') ps from documents))""")
def span_positions(t):
    """TXT-30: all matches with positions."""
    return t("documents").select("doc_id", F.explode(udfs.find_spans(r"[A-Z][a-z]+\.")("text")).alias("s")).select("doc_id", "s.*")


_WRAPPED = ["第一段\n續行\n\n第二段\n（一）小題\n2. 項目\n尾", "a\nb\n(3)x", "one line", "\n\n", "一、甲\n二、乙\n接續", "x\n 　y"]


@query(f"""select conv_id, turn, replace(replace(regexp_replace(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), '\\n([（(]?[一二三四五六七八九十\\d]+[）)、.])', chr(1) || '\\1', 'g'), chr(10), ''), chr(1), chr(10)) as text from {sql_texts(_WRAPPED)}""")
def essay_lines(t):
    """TXT-32: paragraph and sub-item breaks stay, soft wraps go."""
    return texts(t, _WRAPPED).select("conv_id", "turn", tx.essay_lines("text").alias("text"))


@query("""select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([a-z])\\. ([A-Z])', '\\1。\\2', 'g'), '[。？！；\\n]'), lambda s: trim(s)), lambda s: length(s) >= 8) parts from documents""")
def sentence_parts(t):
    """TXT-34."""
    return t("documents").select("doc_id", tx.sentences("text").alias("parts"))


@query("select doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*(?: [A-Za-z][A-Za-z''-]*)*') parts from documents")
def english_segments(t):
    """TXT-24."""
    return t("documents").select("doc_id", tx.english_segments("text").alias("parts"))


@query("select doc_id, translate(text, '()', '（）') wide, translate(translate(text, '()', '（）'), '（）', '()') half from documents")
def bracket_folding(t):
    """TXT-06, REP-15."""
    wide = tx.full_width_brackets("text")
    return t("documents").select("doc_id", wide.alias("wide"), tx.half_width_brackets(wide).alias("half"))


@query("select doc_id, lang from (select doc_id, lang from documents order by doc_id limit 1000) order by md5('42:' || doc_id), doc_id limit 50")
def random_sample(t):
    """ORD-02/04: seeded random rows of the first 1000 in order."""
    from ..operators import search

    return search.random_rows(t("documents").orderBy("doc_id").select("doc_id", "lang"), 50, "doc_id")


# ---- parsers ----

_UPPER = "upper(regexp_replace(text, '[^A-Za-z ]', '', 'g'))"


def upper():
    """Capital letters and blanks of a text: nothing that a text repair touches."""
    return F.upper(F.regexp_replace("text", "[^A-Za-z ]", ""))


def papers_text(t, line, head=None):
    """One text per conversation: its turns' lines in order, behind a head."""
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["l"]), "\n")
    return rows.select("conv_id", (F.concat(F.lit(head), body) if head else body).alias("text"))


def numbered_line():
    n = F.col("turn") + 1
    essay = F.concat(pick(_NUMERALS[:10], F.col("turn")), F.lit("、E "), upper())
    choice = F.concat(n.cast("string"), F.lit(". Q "), upper(), F.lit("\n(A) a (B) b (C) c"), F.when(F.col("turn") % 3 == 0, "").otherwise(" (D) d"))
    return F.when(F.col("turn") % 4 == 3, essay).when(F.col("turn") % 5 == 4, F.concat(n.cast("string"), F.lit(". Q "), upper(), F.lit("\nmore 12345 text"))).otherwise(choice)


_PARSED_SQL = f"""(select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 pos, case when turn % 4 = 3 then {sql_pick(_NUMERALS[:10], 'turn')} else cast(turn + 1 as varchar) end number, case when turn % 4 = 3 then 'essay' else 'choice' end type,
    trim(case when turn % 4 = 3 then 'E ' || {_UPPER} when turn % 5 = 4 then trim('Q ' || {_UPPER}) || ' more  text' else 'Q ' || {_UPPER} end) stem,
    case when turn % 4 = 3 or turn % 5 = 4 then null when turn % 3 = 0 then ['a', 'b', 'c'] else ['a', 'b', 'c', 'd'] end options {_FROM})"""


@query(f"select conv_id, pos, number, type, stem, options from {_PARSED_SQL}")
def parsed_questions(t):
    """GEN-02/05: questions from page text: choices with three or four options or none, essays, lines that go on."""
    q = parsers.parse_questions(papers_text(t, numbered_line()), "conv_id")
    return q.select("conv_id", "pos", "number", "type", "stem", F.map_values("options").alias("options"))


@query(f"select conv_id, number, stem, options from {_PARSED_SQL} where number = '3'")
def single_questions(t):
    """GEN-05: one number of each document."""
    q = parsers.single_question(papers_text(t, numbered_line()), "conv_id", 3)
    return q.select("conv_id", "number", "stem", F.map_values("options").alias("options"))


@query(f"""select conv_id, number, case when cast(number as integer) between 2 and 3 then case when length(stem) < 20 then 'cloze' else 'reading_comprehension' end end subtype, case when cast(number as integer) between 2 and 3 then '請依下文回答第 2 題至第 3 題 THE PASSAGE' end passage from {_PARSED_SQL} where type = 'choice' and turn < 9""")
def reading_groups(t):
    """GEN-05: reading groups: the passage of a range, cloze or comprehension by the stem's length."""
    line = F.when(F.col("turn") == 1, F.concat(F.lit("請依下文回答第 2 題至第 3 題\nTHE PASSAGE\n"), numbered_line())).otherwise(numbered_line())
    q = parsers.reading_groups(papers_text(t, line), "conv_id").where("number_int < 10")
    return q.select("conv_id", "number", "subtype", "passage")


@query(f"""select conv_id, cast(turn + 1 as integer) number, trim(case when turn % 2 = 0 then 'Q ' || {_UPPER} else 'Q ' || {_UPPER} || ' one two' end) || case when turn = 1 then ' 1999. a year in between' else '' end stem,
    case when turn % 2 = 0 then ['w', 'x', 'y', 'z'] end options from conversations where turn + 1 <= 80""")
def english_layout(t):
    """GEN-06: numbers of 1 to 80, options as the four words of a last line."""
    n = F.col("turn") + 1
    line = F.concat(n.cast("string"), F.lit(". Q "), upper(), F.when(F.col("turn") % 2 == 0, "\nw x y z").otherwise("\none two"), F.when(F.col("turn") == 1, "\n999. a year in between").otherwise(""))
    q = parsers.english_questions(papers_text(t, line), "conv_id")
    return q.select("conv_id", "number", F.regexp_replace("stem", " 999\\.", " 1999.").alias("stem"), F.map_values("options").alias("options"))


@query("""select doc_id, case when doc_id % 3 = 0 then '公務人員特種考試' end exam_type_, case when doc_id % 4 = 0 then '警察人員考試' end exam_name, case doc_id % 5 when 0 then '三等' when 1 then '四等' end level,
    source category, lang subject, '2小時' exam_time, case when doc_id % 7 <> 0 then format('{:05d}', doc_id + 10000) end code from documents""")
def paper_metadata(t):
    """GEN-01: header facets, present and absent."""
    d = F.col("doc_id")
    made = F.concat(
        F.when(d % 3 == 0, F.format_string("%d年公務人員特種考試\n", (d % 20 + 100).cast("int"))).otherwise(""), F.when(d % 4 == 0, "警察人員考試\n").otherwise(""), F.when(d % 5 == 0, "三等考試\n").when(d % 5 == 1, "四等考試\n").otherwise(""),
        F.format_string("類科：%s\n科目：%s\n考試時間：2小時\n", F.col("source"), F.col("lang")), F.when(d % 7 != 0, F.format_string("代號：%05d", (d + 10000).cast("int"))).otherwise(""),
    )
    m = t("documents").select("doc_id", made.alias("text")).select("doc_id", *parsers.metadata())
    return m.withColumn("exam_type_", F.when(F.col("exam_type").isNotNull(), "公務人員特種考試")).drop("exam_type")


@query(f"""select conv_id, case when conv_id % 3 > 0 then '12345' end code, count(*) questions, count(*) filter (where type = 'choice') choice, case when conv_id % 2 = 0 then 1 end notes from {_PARSED_SQL} group by conv_id""")
def parsed_documents(t):
    """GEN-04: one row per document with facets, notes and counts."""
    docs = papers_text(t, numbered_line())
    head = F.concat(F.when(F.col("conv_id") % 3 > 0, "代號：12345\n").otherwise(""), F.when(F.col("conv_id") % 2 == 0, "※注意：不必抄題\n").otherwise(""))
    return parsers.parse_documents(docs.withColumn("text", F.concat(head, "text")), "conv_id").select("conv_id", "code", "questions", "choice", F.size("notes").alias("notes"))


@query(f"""select conv_id, number, case when type = 'choice' and len(options) >= 2 then 'choice' else 'essay' end type, case when type = 'choice' and conv_id % 3 = 0 then 'K' || number end answer, options from {_PARSED_SQL} where conv_id < 1000000""")
def parsed_batches(t):
    """GEN-09: copies are parsed once, private-use labels mapped, choices without options made essays, answers merged."""
    docs = papers_text(t, numbered_line()).withColumn("text", F.translate(F.concat(F.lit("※"), F.col("conv_id").cast("string"), F.lit("號\n"), "text"), "※", "#"))
    coded = docs.withColumn("text", F.replace("text", F.lit("(A)"), F.lit("")))
    copies = coded.withColumn("conv_id", F.col("conv_id") + 1_000_000)
    answers = t("conversations").where("conv_id % 3 = 0 and turn % 4 <> 3").select("conv_id", (F.col("turn") + 1).cast("int").alias("number"), F.concat(F.lit("K"), (F.col("turn") + 1).cast("string")).alias("answer"))
    q = parsers.parse_batch(coded.union(copies), "conv_id", answers, {"": "(A)"})
    return q.select("conv_id", "number", "type", "answer", F.map_values("options").alias("options"))


@query("""with l as (select conv_id doc, turn, turn * 12 + (turn // 3) * 60.0 y, text || case when turn % 5 = 4 then '' else '（25 分）' end v from conversations),
    g as (select *, y - lag(y) over (partition by doc order by y) gap from l), m as (select doc, list_sort(list(gap) filter (where gap is not null)) s from g group by doc),
    p as (select g.*, sum(case when gap > greatest(1.5 * s[len(s) // 2 + 1], 30) then 1 else 0 end) over (partition by g.doc order by y) k from g join m on g.doc = m.doc),
    e as (select doc, k, string_agg(v, '' order by y) stem from p group by doc, k having regexp_matches(string_agg(v, '' order by y), '\\d+\\s*分')),
    n as (select *, row_number() over (partition by doc order by k) r from e) select doc, case when r <= 10 then substr('一二三四五六七八九十', cast(r as integer), 1) else cast(r as varchar) end number, stem from n""")
def essays_by_gap(t):
    """GEN-03, WIN-14/15: paragraphs of positioned lines that carry a score mark."""
    text = F.concat("text", F.when(F.col("turn") % 5 == 4, "").otherwise("（25 分）"))
    c = t("conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") * 12 + F.floor(F.col("turn") / 3) * 60).cast("double").alias("y"), text.alias("text"))
    return parsers.essays_by_gap(c, "doc")


@query("""select p.conv_id, n number, case when p.conv_id % 4 = 3 then case when n in (2, 5) then '送分' else substr('ABCD', (p.conv_id + n) % 4 + 1, 1) end when n = 2 then '送分' else substr('ABCD', cast((p.conv_id * n) % 4 + 1 as integer), 1) end answer
    from (select distinct conv_id from conversations) p, range(1, 7) r(n) where p.conv_id % 4 = 3 or n <= 4 or p.conv_id % 2 = 0""")
def answer_tables(t):
    """SRC-10: answer sheets as tables (four columns), with the rest, or everything, in running text."""
    c = t("conversations").select("conv_id").distinct()
    letter = lambda i: F.substring(F.lit("ABCD"), i.cast("int") + 1, F.lit(1))
    four = [F.lit(n) for n in range(1, 5)]
    header = F.array(F.lit("題號"), *[F.concat(F.lit("第"), n.cast("string"), F.lit("題")) for n in four])
    own = F.array(F.lit("答案"), *[F.when(n == 2, "一律給分").otherwise(F.concat(F.lit(" "), letter((F.col("conv_id") * n) % 4))) for n in four])
    rows = F.array(F.struct(F.lit(0).alias("row"), header.alias("cells")), F.struct(F.lit(1).alias("row"), own.alias("cells")))
    cells = c.where("conv_id % 4 <> 3").select("conv_id", F.lit(0).alias("page"), F.lit(0).alias("table"), F.explode(rows).alias("r")).select("conv_id", "page", "table", "r.*")
    pair = lambda n, v: F.concat(F.lit(f"第{n}題 "), v)
    all_ = F.array_join(F.array(*[pair(n, letter((F.col("conv_id") + n) % 4)) for n in (1, 3, 4, 6)]), "\n")
    text = F.when(F.col("conv_id") % 4 == 3, F.concat(all_, F.lit("\n第 2 題及第5題均一律給分\n第5題送分"))).when(F.col("conv_id") % 2 == 0, F.concat(pair(1, F.lit("X 第1題 A")), F.lit("\n"), pair(5, letter((F.col("conv_id") * 5) % 4)), F.lit("\n"), pair(6, letter((F.col("conv_id") * 6) % 4)))).otherwise("")
    return parsers.answer_tables(cells, c.select("conv_id", F.lit(0).alias("page"), text.alias("text")), "conv_id")


@query("""with q as (select conv_id, turn pos, role = 'assistant' e, row_number() over (partition by conv_id order by turn) k, turn + 1 n from conversations where turn % 3 <> 1), c as (select conv_id, count(*) asked from q group by 1)
    select q.conv_id, pos, case when q.conv_id % 3 = 0 then 'image' else 'page' end source, cast(case when q.conv_id % 3 = 0 then (k - 1) * 10 when e then least(n, 3) when n = 3 and q.conv_id % 2 = 0 then 1 else least(k, 3) end as bigint) "at" from q join c on q.conv_id = c.conv_id""")
def figure_assignment(t):
    """GEN-12: figures of questions: embedded images in order, else a page."""
    c = t("conversations")
    essay = F.col("role") == "assistant"
    q = c.select("conv_id", F.col("turn").alias("pos"), F.when(essay, "essay").otherwise("choice").alias("type"), (F.col("turn") + 1).cast("string").alias("number"), F.when(F.col("turn") % 3 == 1, "無圖").otherwise(pick(["如圖一所示", "見附圖", "如下圖"], F.col("turn"))).alias("stem"))
    images = c.where("conv_id % 3 = 0").select("conv_id", (F.col("turn") * 10).alias("image"))
    page = F.explode(F.sequence(F.lit(0), F.lit(3)))
    pages = c.select("conv_id").distinct().select("conv_id", page.alias("page")).withColumn("text", F.when((F.col("page") == 1) & (F.col("conv_id") % 2 == 0), "3 圖").otherwise("none"))
    return parsers.assigned_figures(q, images, pages, "conv_id")


@query(f"""select file_id, count(*) questions, min(number) first from (select conv_id file_id, number from {_PARSED_SQL}) group by 1""")
def note_questions(t):
    """REP-16: questions that stand among the notes."""
    f = papers_text(t, numbered_line()).select(F.col("conv_id").alias("file_id"), F.concat(F.array(F.lit("※注意：不必抄題")), F.split("text", "\n")).alias("notes"))
    return parsers.questions_from_notes(f).groupBy("file_id").agg(F.count("*").alias("questions"), F.min("number").alias("first"))


@query(f"""with e as (select conv_id, pos, number, stem from {_PARSED_SQL} where type = 'essay'), k as (select *, row_number() over (partition by conv_id order by pos) r from e),
    kept as (select conv_id, r - 1 pos, number, stem from k where conv_id % 3 > 0 and r = 1), new as (select conv_id, row_number() over (partition by conv_id order by pos) - 1 + case when conv_id % 3 > 0 then 1 else 0 end pos, number, stem from k where not (conv_id % 3 > 0 and r = 1))
    select * from kept union all select * from new""")
def filled_essays(t):
    """REP-21: essays that a paper lacks come from its page text; of two papers in three the first is there already."""
    docs = papers_text(t, numbered_line()).withColumnRenamed("conv_id", "file_id")
    have = parsers.parse_questions(docs, "file_id").where("type = 'essay' and file_id % 3 > 0")
    first = have.groupBy("file_id").agg(F.min_by(F.struct("number", "type", "stem", "section"), "pos").alias("q")).select("file_id", F.lit(0).cast("int").alias("pos"), "q.*")
    return repairs.filled_essays(first, docs).select(F.col("file_id").alias("conv_id"), F.col("pos").cast("long").alias("pos"), "number", "stem")


# ---- pages, sinks, sources, the reader's page ----


@query("""select format('{:05d}', conv_id) subject, count(*) n, count(*) filter (where role = 'user') with_options from conversations where conv_id % 10 < 8 group by conv_id""")
def rendered_cards(t):
    """SNK-08, SRC-12: papers rendered as cards and read back."""
    from .corpus_queries import typed

    c = typed(t)
    cards = sinks.rendered_cards(c.questions, c.files)
    return cards.select("subject", F.explode(udfs.question_cards("html")).alias("c")).groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.size("c.options") == 4).alias("with_options"))


@query("""with f as (select distinct conv_id, 'cat' || conv_id % 5 category, conv_id % 20 + 100 y, format('{:05d}', conv_id) s from conversations where conv_id % 10 < 8)
    select category, count(*) papers, list(y || ' ' || s order by y desc, s) entries from f group by category""")
def rendered_pages(t):
    """SNK-08: the page of each category with its list of cards, read back."""
    from .corpus_queries import typed

    c = typed(t)
    p = sinks.rendered_pages(sinks.rendered_cards(c.questions, c.files))
    return p.select("category", "papers", F.regexp_extract_all("html", F.lit("<li>([^<]*)</li>"), F.lit(1)).alias("entries"))


@query("select conv_id, turn, cast(case when n > 0 then (((sum(s) over (partition by conv_id order by turn) - 1) % n) + n) % n else -1 end as bigint) hit from (select conv_id, turn, case turn % 3 when 2 then -1 else 1 end s, conv_id % 4 n from conversations)")
def hit_navigation(t):
    """CLI-03: next and previous hit with wraparound."""
    c = t("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, -1).otherwise(1).alias("step"), (F.col("conv_id") % 4).alias("total"))
    return client.walked_hits(c, "conv_id", "turn", "step", "total").select("conv_id", "turn", F.col("hit").cast("long").alias("hit"))


@query("select doc_id, lang, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 hits from documents where contains(lower(text), 'the')")
def visible_cards(t):
    """CLI-09: what an export of visible cards without answers holds."""
    return client.visible(t("documents").withColumn("answer", F.lit("A")), query="The", text="text").drop("text", "source", "n_chars")


@query("select user_id, cast(epoch(time_bucket(interval '1 hour', cast(ts as timestamp))) as bigint) start, count(*) n from events group by 1, 2")
def event_windows(t):
    """The streaming extension's tumbling counts, on a batch."""
    e = t("events").withColumn("at", F.col("ts").cast("timestamp"))
    return watch.event_counts(e, "at", "user_id").select("user_id", F.unix_timestamp("start").alias("start"), "n")


def _decoder(raw: bytes) -> list[tuple]:
    """A stand-in for a PDF library: pages are separated by form feeds."""
    return [(i, text) for i, text in enumerate(raw.decode().split("\f"))]


def _words(raw: bytes) -> list[tuple]:
    return [(i, float(10 * k), float(i), w) for i, text in enumerate(raw.decode().split("\f")) for k, w in enumerate(text.split())]


def _files(t):
    two = F.concat(F.col("item_id").cast("string"), F.lit(" first page\f"), plain(), F.when(F.col("item_id") % 5 == 0, F.lit("\f")).otherwise(""))
    return t("benchmark").select(F.col("item_id").cast("string").alias("path"), F.when(F.col("item_id") % 7 == 3, F.lit(b"\xff\xfe")).otherwise(two.cast("binary")).alias("content"))


@query(f"""select cast(item_id as varchar) path, cast(k - 1 as integer) page, p as text from (select item_id, unnest(ps) p, unnest(range(1, len(ps) + 1)) k from (select item_id, string_split(item_id || ' first page' || chr(12) || {PLAIN_SQL} || case when item_id % 5 = 0 then chr(12) else '' end, chr(12)) ps from benchmark where item_id % 7 <> 3))""")
def page_texts(t):
    """SRC-07: pages of binary papers by the caller's decoder; a broken file gives none."""
    return pdftext.pages(_files(t), _decoder)


@query(f"""select cast(item_id as varchar) path, cast(k - 1 as integer) page, cast(10 * (i - 1) as double) x, w as text from (select item_id, k, unnest(ws) w, unnest(range(1, len(ws) + 1)) i from (select item_id, k, list_filter(string_split_regex(p, '\\s+'), lambda z: z <> '') ws
    from (select item_id, unnest(ps) p, unnest(range(1, len(ps) + 1)) k from (select item_id, string_split(item_id || ' first page' || chr(12) || {PLAIN_SQL} || case when item_id % 5 = 0 then chr(12) else '' end, chr(12)) ps from benchmark where item_id % 7 <> 3))))""")
def page_words(t):
    """SRC-08: positioned words by the caller's decoder."""
    return pdftext.words(_files(t), _words).select("path", "page", "x", "text")


@query("select cast(item_id as varchar) path from benchmark where item_id % 7 = 3")
def failed_files(t):
    """SRC-07: files that the decoder can't read."""
    f = _files(t)
    return pdftext.failed(f, pdftext.pages(f, _decoder))


@query("select page_id, url, case when page_id % 2 = 0 then 'new' else 'old' end state from pages")
def saved_versions(t):
    """SNK-02/04/13: a new version beside the old one, and a snapshot of what changed, read back."""
    spark, root = t("pages").sparkSession, shared_folder(t("region").sparkSession)
    old = t("pages").select("page_id", "url", F.lit("old").alias("state"))
    first = sinks.write_version(old, root + "/versions", "1")
    second = sinks.write_version(old.where("page_id % 2 = 0").withColumn("state", F.lit("new")), root + "/versions", "2")
    read = lambda p: spark.read.schema("page_id long, url string, state string").json(p)
    done = sinks.save_progress(spark, read(second).select("page_id"), root + "/progress")
    return read(first).join(done, "page_id", "left_anti").unionByName(read(second))


@query("select cast(page_id as varchar) number, 'stem, \"' || page_id || '\"' || chr(10) || 'x' stem, case when page_id % 2 = 0 then 'A' end answer from pages")
def batch_rows(t):
    """SRC-17: question rows from a CSV with quotes, line breaks and absent columns."""
    path = shared_folder(t("region").sparkSession) + "/batch"
    rows = t("pages").select(F.col("page_id").cast("string").alias("number"), F.concat(F.lit('stem, "'), F.col("page_id").cast("string"), F.lit('"\nx')).alias("stem"), F.when(F.col("page_id") % 2 == 0, "A").alias("answer"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_batch_csv(t("pages").sparkSession, path).select("number", "stem", "answer")


@query("select cast(item_id as varchar) number, substr('ABCD', cast(item_id % 4 + 1 as integer), 1) answer from benchmark where item_id % 3 <> 2")
def key_files(t):
    """SRC-20: answer keys as JSON objects and as lists, blank answers left out."""
    path = shared_folder(t("region").sparkSession) + "/keys"
    n, a = F.col("item_id").cast("string"), F.substring(F.lit("ABCD"), (F.col("item_id") % 4 + 1).cast("int"), F.lit(1))
    a = F.when(F.col("item_id") % 3 == 2, " ").otherwise(a)
    kind = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('{"'), n, F.lit('": "'), a, F.lit('"}'))).otherwise(F.concat(F.lit('[{"number": "'), n, F.lit('", "answer": "'), a, F.lit('"}]')))
    rows = t("benchmark").select(kind.alias("value"), F.col("item_id"))
    spark = t("benchmark").sparkSession
    rows.write.partitionBy("item_id").text(path)
    return tables.read_answer_key(spark, path).select("number", "answer")


@query("""with c as (select conv_id, turn, role, text, md5(cast(conv_id as varchar)) id from conversations) select conv_id, count(*) questions, count(*) filter (where role = 'user') choice from c group by 1""")
def arriving_papers(t):
    """New papers of a stream, checked row by row: here a batch of JSON papers, counted by kind."""
    c = t("conversations")
    one = F.struct((F.col("turn") + 1).cast("int").alias("number"), F.when(F.col("role") == "user", "choice").otherwise("essay").alias("type"), F.col("text").alias("stem"))
    papers = c.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(one).alias("questions"))).alias("raw"))
    items = papers.withColumn("doc", F.try_parse_json("raw")).select("conv_id", F.explode(F.try_variant_get("doc", "$.questions", "array<variant>")).alias("q")).select("conv_id", *corpus.question_columns(F.col("q")))
    return items.groupBy("conv_id").agg(F.count("*").alias("questions"), F.count_if(F.col("type") == "choice").alias("choice"))
