"""Text functions, parsers and pandas functions against hand-computed results."""

import pytest
from pyspark.sql import functions as F

from stemquarry.functions import text as tx
from stemquarry.functions import udfs
from stemquarry.operators import parsers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f,given,want",
    [
        (tx.repair_broken_words, "nati on th at wh ich in to", "nation that which into"),
        (tx.repair_broken_words, "中th at文", "中th at文"),
        (tx.drop_paper_codes, "a 12345 b 123456", "a  b 123456"),
        (tx.collapse_spaced_cjk, "中 文　字 a 字", "中文字 a 字"),
        (tx.half_width_brackets, "（a）", "(a)"),
        (tx.comparison_key, "A，b　C。", "a,bc."),
        (tx.strip_invisible, "a\x01​b", "ab"),
        (tx.clean_blanks, "  a \t b \n c  ", "a b\nc"),
        (tx.squeeze_spaces, "a    b  c", "a b  c"),
        (tx.strip_trailing_noise, "text - 、", "text"),
        (tx.strip_page_residue, "a第 3 頁b 請接背面 x", "ab "),
        (tx.clean_exam_time, "2小時 座號：___", "2小時"),
        (tx.strip_trailing_pipe, "a | |", "a"),
        (tx.split_camel, "helloWorld", "hello World"),
        (tx.space_digits, "3abc de4", "3 abc de 4"),
        (tx.shorten_subject, "x（a、b、c、d、e）", "x（a、b等）"),
        (tx.safe_file_name, 'a/b:c  "d"', "a_b_c _d_"),
        (tx.escape_html, '<a href="x">&', "&lt;a href=&quot;x&quot;&gt;&amp;"),
        (tx.essay_lines, "one\ntwo\n\nthree\n(一) four", "onetwo\nthree\n(一) four"),
        (udfs.nfkc, "ＡＢ①", "AB1"),
        (udfs.visible_text, "<p>a &amp; b</p><script>x</script><p>c", "a & b\nc"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_null_texts(spark):
    for f in (tx.repair_broken_words, tx.comparison_key, tx.clean_blanks, udfs.nfkc, udfs.visible_text):
        assert one(spark, None, f) is None


def test_numbers(spark):
    assert [one(spark, x, tx.numeral_value) for x in ("一", "十", "十二", "二十", "百")] == [1, 10, 12, 20, None]
    assert one(spark, ["注意", "共 40 題"], tx.declared_count, "array<string>") == 40
    assert one(spark, ["none"], tx.declared_count, "array<string>") is None
    assert one(spark, "110-112", tx.year_list) == [110, 111, 112] and one(spark, "110, 112", tx.year_list) == [110, 112]


def test_containment(spark):
    rows = [("abcdefghijkl", "xxabcdefghijklxx", 1), ("abcdefghijkl", "defghi", 2), ("abcdefghijkl", "zzz", 0)]
    df = spark.createDataFrame(rows, "p string, t string, want int").select("want", tx.containment_level("p", "t").alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_segmentation(spark):
    f = {"information": 50, "security": 50, "and": 100}
    assert udfs.segment_word("informationandsecurity", f) == ["information", "and", "security"]
    assert one(spark, "informationSecurity x", udfs.segment_words(f)) == "information Security x"
    assert one(spark, "the infor mation age", udfs.merge_fragments({"information", "the", "age"})) == "the information age"
    assert one(spark, "a re port b", udfs.merge_fragments({"report"})) == "a report b"


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("a", None)], "a string, b string").select(udfs.ratio("a", "b").alias("r"), udfs.differences("a", "b").alias("d")).collect()
    assert [r.r for r in df] == [0.75, 1.0, None]
    assert [(x.op, x.left, x.right) for x in df[0].d] == [("replace", "c", "x")]


PAGE = """112年公務人員特種考試 三等考試
類科：資訊
代號：12345
※注意：禁止使用電子計算器。
不必抄題。
甲、申論題
一、請說明作業系統。（25分）
續行內容
乙、測驗題
1. 下列何者正確？
(A) 甲案 (B) 乙案
(C) 丙案 (D) 丁案
2. What is th e answer
continued here
"""


def test_parser(spark):
    docs = spark.createDataFrame([(7, PAGE), (8, None), (9, "")], "doc long, text string")
    rows = parsers.parse_questions(docs, "doc").orderBy("doc", "pos").collect()
    assert [(r.pos, r.number, r.type, r.section) for r in rows] == [(0, "一", "essay", "甲、申論題"), (1, "1", "choice", "乙、測驗題"), (2, "2", "choice", "乙、測驗題")]
    assert rows[0].stem == "請說明作業系統。（25分）\n續行內容"
    assert rows[1].stem == "下列何者正確？" and rows[1].options == {"A": "甲案", "B": "乙案", "C": "丙案", "D": "丁案"}
    assert rows[2].stem == "What is the answer continued here"
    assert parsers.notes_of(docs, "doc").first().notes == ["※注意：禁止使用電子計算器。", "不必抄題。"]
    m = docs.where("doc = 7").select(*parsers.metadata()).first()
    assert (m.level, m.code, m.category) == ("三等", "12345", "資訊")


def test_answer_lines(spark):
    df = spark.createDataFrame([(1, 0, "題號 1 2 3"), (1, 1, "答案 A B #"), (1, 2, "備註：第3題答Ａ或Ｂ者均給分")], "doc long, line long, text string")
    assert sorted((r.number, r.answer) for r in parsers.answers_of(df, "doc").collect()) == [(1, "A"), (2, "B"), (3, "#")]
    assert [(r.number, r.answer) for r in parsers.corrections_of(df.where("line = 2"), "doc").collect()] == [(3, "A或B")]


def test_option_grouping():
    """Groups of lines and of words against all ways to cut them."""
    import random
    from itertools import combinations

    from stemquarry.operators import options

    r = random.Random(3)
    for _ in range(300):
        lines = ["x" * r.randint(1, 12) for _ in range(r.randint(5, 9))]
        longest, best, want = max(map(len, lines)), None, None
        for c in combinations(range(1, len(lines)), 3):
            parts = [lines[a:b] for a, b in zip((0, *c), (*c, len(lines)))]
            sizes = [len("".join(p)) for p in parts]
            worth = sum(longest - len(p[-1]) for p in parts[:3]) - 200 * sum(s < 5 for s in sizes)
            if min(sizes) >= 2 and (best is None or worth > best):
                best, want = worth, parts
        assert options.grouped(lines) == want
    assert options.grouped(["a"]) is None and options.grouped(["甲 乙 丙 丁"]) == [["甲"], ["乙"], ["丙"], ["丁"]] and options.grouped(list("abcd")) == [["a"], ["b"], ["c"], ["d"]]
    assert len(options.grouped(["long enough a line"] * 400)) == 4  # no enumeration of all cuts


def test_blocks_equal_the_standard_matcher():
    import difflib
    import random

    from stemquarry.functions.matching import BlockMatcher

    r = random.Random(1)
    for _ in range(600):
        letters, n = r.choice(["ab", "abcde", "abcdefghijklmnopqrstuvwxyz ", "aé中b"]), r.choice([0, 1, 5, 30, 250, 400])
        a = "".join(r.choice(letters) for _ in range(r.randint(0, n)))
        b = list(a) if r.random() < 0.5 else [r.choice(letters) for _ in range(r.randint(0, n))]
        for _ in range(r.randint(0, 12) if b else 0):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 2)] = r.choice(letters) * r.randint(1, 4)
        b = "".join(b)
        for junk in (True, False):
            want, got = difflib.SequenceMatcher(None, a, b, autojunk=junk), BlockMatcher(a, b, junk)
            assert got.get_matching_blocks() == want.get_matching_blocks() and got.ratio() == want.ratio() and got.get_opcodes() == want.get_opcodes()


@pytest.mark.parametrize("junk", [True, False])
def test_long_texts_keep_the_measure(junk):
    """Texts of 50,000 characters, with moved and changed parts: few repeated characters, so the plain matcher is quick."""
    import difflib
    import random

    from stemquarry.functions.matching import BlockMatcher

    r = random.Random(2)
    a = "".join(chr(0x4E00 + r.randrange(8000)) for _ in range(50_000))
    b = a[30_000:41_000] + a[:9_000] + "".join(c if r.random() < 0.9 else "x" for c in a[9_000:30_000]) + a[41_000:][::-1]
    assert len(b) == 50_000
    want = difflib.SequenceMatcher(None, a, b, autojunk=junk)
    assert BlockMatcher(a, b, junk).get_matching_blocks() == want.get_matching_blocks()


def test_similarity_has_no_length_switch(spark):
    """The pair that was 0.0 below 20,000 characters and 1.0 above."""
    rows = [("ab" * n, "ba" * n) for n in (9_999, 10_500)]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(udfs.ratio_exact("a", "b").alias("s")).collect()]
    assert got == [pytest.approx(2 * (2 * n - 1) / (4 * n)) for n in (9_999, 10_500)]


def noise_by_pattern(text):
    """TXT-12 as three patterns (on short texts these are quick)."""
    import re

    for p in (r"(?:[ \t\n\x0b\f\r]*-[ \t\n\x0b\f\r]*[、-]?)+[ \t\n\x0b\f\r]*\Z", r"[ \t\n\x0b\f\r]*[、,;；][ \t\n\x0b\f\r]*\Z", r"[ \t\n\x0b\f\r]+-?[0-9]{1,2}-?[ \t\n\x0b\f\r]*\Z"):
        text = re.sub(p, "", text, count=1)
    return text


def test_noise_and_segments_equal_their_patterns(spark):
    import random
    import re

    r = random.Random(3)
    texts = ["".join(r.choice(["a", "題", "-", "-", "、", " ", " ", "\n", "7", "12", ",", "；"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(r.choice(["ab", "I", "'", "-", " ", " ", "  ", "é", "\x01", "9", "."]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.strip_trailing_noise("t").alias("n"), tx.english_segments("t").alias("e"), tx.space_digits("t").alias("d")).collect()
    for row in got:
        assert row.n == noise_by_pattern(row.t), row.t
        assert row.e == re.findall(r"[A-Za-z][A-Za-z'-]*(?: [A-Za-z][A-Za-z'-]*)*", row.t), row.t
        assert row.d == re.sub(r"([A-Za-z]{2,})([0-9])", r"\1 \2", re.sub(r"([0-9])([A-Za-z]{2,})", r"\1 \2", row.t)), row.t


def test_no_text_ends_the_session(spark):
    """Every text function on 30,000 words, on 20,000 repeats of each mark, and on such repeats before a letter."""
    marks = [" ", "-", " -", "、", "-、", "a", "A", "aB", "7", "a7", "ab7", "\n", "\n ", "(", "（", "「", "中", "中 ", "|", "'", "座", "座 ", "第 3 ", "A或", "<p>", "&"]
    texts = [" ".join(f"word{i % 97}x" for i in range(30_000)), "one two " * 15_000] + [m * (20_000 // len(m)) + end for m in marks for end in ("", "z")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    plain = [
        tx.repair_broken_words, tx.drop_paper_codes, tx.collapse_spaced_cjk, tx.half_width_brackets, tx.full_width_brackets, tx.comparison_key, tx.loose_key, tx.strip_invisible,
        tx.clean_blanks, tx.squeeze_spaces, tx.strip_trailing_noise, tx.strip_page_residue, tx.clean_exam_time, tx.strip_trailing_pipe, tx.split_camel, tx.space_digits, tx.has_cjk,
        tx.shorten_subject, tx.safe_file_name, tx.escape_html, tx.essay_lines, tx.sentences, tx.english_segments, tx.answer_letters, tx.marker_count, tx.hash_prefix, tx.numeral_value,
    ]
    out = df.select(*[F.hash(f("t")).alias(f"f{i}") for i, f in enumerate(plain)], F.hash(tx.occurrences("t", "ab")).alias("o"), F.hash(tx.snippet("t", "z")).alias("s"))
    assert out.where("f0 is not null").count() == len(texts)
    sums = out.agg(*[F.sum(c).alias(c) for c in out.columns]).first()
    assert all(v is not None for v in sums)
