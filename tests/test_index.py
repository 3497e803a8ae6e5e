"""The keyword index, containment without a key, and dictionaries of any size."""

import random

import pytest
from pyspark.sql import functions as F

from stemquarry.operators import grams, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.upper("source").alias("source"))
    odd = spark.createDataFrame([(100_000, None, "x"), (10**12, "", None), (10**12 + 1, "İstanbul ÄÖ 中文題目", "ab\0cd"), (70_000, "50%_off \\ path", "a"), (None, "lost", "lost")], d.schema)
    return grams.write_index(d.unionByName(odd), str(tmp_path_factory.mktemp("index")), "doc_id", ("text", "source"), block_bytes=64 << 10)


@pytest.mark.parametrize("fetched", [10_000, 3])
@pytest.mark.parametrize("text", ["th", "the", "Tion", "SRC1", "rc1", "中文", "題", "%_", "50%_OFF", "\\ p", "äö", "i̇s", "zzzzz", "e. the", "ab", "b\0c"])
def test_rows_equal_a_scan(index, text, fetched):
    want = {r.doc_id for r in index.rows.where(search.keyword(text, index.columns)).where("doc_id is not null").collect()}
    assert {r.doc_id for r in grams.indexed_rows(index, text, fetched=fetched).where("doc_id is not null").collect()} == want


@pytest.mark.parametrize("text", ["th%tion", "t_e a", "%", "_", "src_", "a%_z%the", "%%"])
def test_wildcards_equal_a_scan(index, text):
    want = {r.doc_id for r in index.rows.where(search.keyword(text, index.columns, True)).where("doc_id is not null").collect()}
    assert {r.doc_id for r in grams.indexed_rows(index, text, True).where("doc_id is not null").collect()} == want


def read_bytes(spark, df):
    """(rows, bytes that the scans of a query read)."""
    sc = spark.sparkContext
    store, group = sc._jsc.sc().statusStore(), f"bytes-{random.random()}"
    sc.setJobGroup(group, group)
    rows = df.count()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = [s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    return rows, sum(store.lastStageAttempt(s).inputBytes() for s in stages if sc.statusTracker().getStageInfo(s))


def test_a_keyword_reads_few_bytes(spark, tmp_path):
    """Forty copies of the table, one of which holds a rare word: the index reads a fraction of what a scan reads."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = d.crossJoin(spark.range(40)).select((F.col("doc_id") + 1000 * F.col("id")).alias("doc_id"), F.when((F.col("id") == 7) & (F.col("doc_id") == 5), "a rare quzzword").otherwise(F.concat("text", F.col("id").cast("string"))).alias("text"))
    index = grams.write_index(rows, str(tmp_path / "index"), "doc_id", ("text",), block_bytes=128 << 10)
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")  # its reads in other threads aren't counted
    scanned = read_bytes(spark, index.rows.where(search.keyword("quzzword", ("text",))))
    looked_up = read_bytes(spark, grams.candidates(index, "quzzword"))
    fetched = read_bytes(spark, grams.indexed_rows(index, "quzzword"))
    spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    assert scanned[0] == looked_up[0] == fetched[0] == 1
    assert fetched[1] < scanned[1] / 5, (scanned, looked_up, fetched)


def test_filters_reach_the_scans(index, capsys):
    index.lists.where(F.col("gram").isin([5, 6])).explain("formatted")
    grams.indexed_rows(index, "SRC1").explain("formatted")
    plan = capsys.readouterr().out
    assert "In(gram, [5,6])" in plan and "In(doc_id" in plan


@pytest.mark.parametrize("held", [2_000_000, 10])
def test_containment_equals_a_cross_join(spark, held):
    r = random.Random(3)
    texts = ["".join(r.choice("abc 中é.") for _ in range(r.randint(0, 120))) for _ in range(150)] + ["hot passage of many " * 3] * 60 + [None, ""]
    phrases = [x[k : k + r.randint(1, 14)] for x in texts if x for k in [r.randint(0, len(x))]] + ["hot passage", "hot", "", None, "nowhere at all", "e", "中"]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    p = spark.createDataFrame([(f"p{i}", x) for i, x in enumerate(phrases)], "id string, phrase string").repartition(2)
    got = [(x.id, x.doc_id) for x in grams.contained_anywhere(p, t, "id", "phrase", "doc_id", "text", held_grams=held).collect()]
    want = {(f"p{i}", d) for i, x in enumerate(phrases) if x for d, text in enumerate(texts) if text and x in text}
    assert len(got) == len(want) and set(got) == want


def letters(n):
    """A number in base 26."""
    out = ""
    while True:
        out = chr(97 + n % 26) + out
        n //= 26
        if not n:
            return out


class Numbered(dict):
    """The dictionary of the test below, by rule: the numbers under a bound in letters, with n of them."""

    def get(self, word, default=None):
        n = 0
        for c in word:
            n = 26 * n + ord(c) - 97
        return n % 150 + 1 if n < 5_000_000 and word == letters(n) else default


def test_five_million_words_split_as_in_memory(spark):
    from stemquarry.functions import udfs
    from stemquarry.operators import dictionary

    digit = lambda k: F.char(F.lit(97) + (F.floor(F.col("id") / 26**k) % 26).cast("int"))
    word = F.concat(*[F.when((F.col("id") >= 26**k) | F.lit(k == 0), digit(k)).otherwise("") for k in range(4, -1, -1)])
    words = spark.range(0, 5_000_000, 1, 8).select(word.alias("word"), (F.col("id") % 150 + 1).cast("int").alias("n"))
    assert {(r.word, r.n) for r in words.where("word in ('a', 'z', 'ba')").collect()} == {("a", 1), ("z", 26), ("ba", 27)}
    r = random.Random(1)
    texts = [" ".join("".join(letters(r.randrange(6_000_000)) for _ in range(r.randint(1, 5))) + r.choice(["", "Xyzzyab", "1"]) for _ in range(6)) for _ in range(60)] + [None, "", "short", "A" * 60]
    texts += ["thesamerunagainandagain hot"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = {x.id: x.text for x in dictionary.split_words(df, "id", "text", words).collect()}
    rule = Numbered()
    import re

    want = {i: None if x is None else re.sub("[A-Za-z]{8,}", lambda m: udfs.split_run(m[0], rule), x) for i, x in enumerate(texts)}
    assert got == want and any(want[i] != texts[i] for i in want)


def test_fragments_join_as_in_memory(spark):
    from stemquarry.functions import udfs
    from stemquarry.operators import dictionary

    known = ["information", "government", "inform", "forward", "ward", "in", "nation"]
    texts = ["infor mation is in for mation", "Inform ation", "govern ment na tion", "for ward", "not here", None, "", "a  b", "in form ation x7 na  tion"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = spark.createDataFrame([(w,) for w in known * 2], "word string")
    for standalone in ((), ("ward",)):
        got = {x.id: x.text for x in dictionary.join_fragments(df, "id", "text", words, standalone).collect()}
        assert got == {i: None if x is None else udfs.merge_text(x, set(known), standalone) for i, x in enumerate(texts)}


def test_the_layout_joins_in_place_and_skips_row_groups(spark, capsys):
    from stemquarry.sources import layout

    n = 40_000
    questions = spark.range(n).select((F.col("id") % 2000).alias("file_id"), F.floor(F.col("id") / 2000).cast("int").alias("pos"), F.col("id").cast("string").alias("number"), F.lit("choice").alias("type"), F.when(F.col("id") == 777, "odd one").otherwise(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 6)).alias("answer"), F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 30).alias("stem"))
    files = spark.range(2000).select(F.col("id").alias("file_id"), (F.col("id") % 7).cast("string").alias("category"), (F.col("id") % 9).alias("year"), F.lit("s").alias("subject"))
    index = layout.write_layout(files, questions, buckets=4, block_bytes=256 << 10)
    try:
        joined = index.questions.join(index.files, "file_id").where("category = '3'")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined.explain("formatted")
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        assert joined.count() == questions.join(files, "file_id").where("category = '3'").count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
        whole = read_bytes(spark, index.questions.where("length(stem) > 5"))
        one = read_bytes(spark, index.questions.where("answer = 'odd one' and length(stem) > 5"))
        spark.conf.unset("parquet.hadoop.vectored.io.enabled")
        assert whole[0] == n and one[0] == 1 and one[1] < whole[1] / 4, (whole, one)
    finally:
        index.drop()
