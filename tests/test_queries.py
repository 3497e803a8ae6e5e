"""Every registered query of the engine against its SQL counterpart in DuckDB."""

import math

import duckdb
import pytest

from stemquarry.plans import catalogue

from . import test_plain

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, (bool, str, bytes)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(x) else round(x, 6)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert name in test_plain.PLAIN, "a query needs SQL or a plain version"
        return  # compared in test_plain.py
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(norm(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_stratified_sample_fills_up(spark):
    from stemquarry.operators import search

    df = spark.range(100).selectExpr("id", "case when id < 90 then 'a' when id < 97 then 'b' else 'c' end g")
    got = search.stratified_sample(df, "g", 30, "id")
    n = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert sum(n.values()) == 30 and n["b"] == 7 and n["c"] == 3


def test_search_pushes_filters(spark, capsys):
    from pyspark.sql import functions as F

    from stemquarry.operators import search

    q = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.lit(0).alias("pos"), F.lit("1").alias("number"), F.col("lang").alias("type"), F.col("text").alias("stem"), F.lit("A").alias("answer"))
    f = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.col("source").alias("category"), F.col("n_chars").alias("year"), F.col("lang").alias("subject"))
    search.search(q, f, year=5, qtype="en", text_columns=("stem",)).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(n_chars,5)" in plan and "EqualTo(lang,en)" in plan


def test_dictionaries_hold_all_words(spark, tmp_path, monkeypatch):
    from itertools import islice, product

    from stemquarry.sources import tables

    filler = ["".join(x) for x in islice(product("abcde", repeat=5), 1200)]  # before the others in alphabet and count
    rows = [(0, ";".join(filler)), (1, ";".join(filler)), (2, "zebra"), (3, "quartz"), (4, "zephyr"), (5, "quartz zephyr")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = lambda name: {r.item_id: r.text for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert text("merged_fragments")[2] == "zebra"
    assert text("segmented_words")[5] == "quartz zephyr"
    monkeypatch.setattr(tables, "DICTIONARY_WORDS", 1000)
    assert text("merged_fragments")[2] == "zebra"  # the bound of a dictionary in memory doesn't hold for a table
    words = spark.createDataFrame([(w, 1) for w in filler], "word string, n int")
    with pytest.raises(ValueError, match="more than 1000 words"):
        tables.collected_words(words, "filler")


def test_ids_are_dense_and_unique_at_any_partitioning(spark):
    """A million rows with a payload, hot and null keys, adaptive execution on."""
    from pyspark.sql import functions as F

    from stemquarry.sources import corpus

    rows = spark.range(0, 1_000_000, 1, 12).select(F.when(F.col("id") % 1000 == 0, None).when(F.col("id") % 10 == 1, "hot").otherwise(F.md5(F.col("id").cast("string").cast("binary"))).alias("path"), "id", F.repeat(F.lit("x"), 50).alias("payload"))
    out = corpus.dense_ids(rows, "n", "path", "id")
    assert set(out.columns) == {"path", "id", "payload", "n"}
    got = out.agg(F.count("*").alias("n"), F.count_distinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b"), F.count_distinct("id").alias("ids")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 1, 1_000_000, 1_000_000)
    ends = out.where("n in (1, 1000, 1001, 600000)").orderBy("n").collect()
    want = rows.orderBy("path", "id").limit(1001).collect()
    assert [(r.path, r.id) for r in ends[:3]] == [(want[i].path, want[i].id) for i in (0, 999, 1000)]
    assert corpus.dense_ids(rows.where("false"), "n", "path").count() == 0


def test_a_content_copied_very_often_is_spread(spark):
    from pyspark.sql import functions as F

    from stemquarry.operators import sets

    rows = spark.range(2000).select("id", F.when(F.col("id") < 1500, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = sets.flag_copies(rows, F.col("text"), "id")
    assert got.where("is_copy").count() == 1499 and got.where("copy_of = 0").count() == 1500 and got.columns == ["id", "text", "copy_of", "is_copy"]
    assert got.count() == 2000


def test_pairs_stand_for_the_last_of_their_rows(spark):
    from stemquarry.operators import joins

    rows = spark.createDataFrame([("g", "a", 1), ("g", "a", 2), ("g", "b", 3), ("h", "a", 4)], "grp string, k string, v int")
    assert [tuple(r) for r in joins.pairs_within(rows, ["grp"], "k").collect()] == [("g", "a", 2, "b", 3)]


def test_guards_never_hide_a_hit():
    """What a guard lets through holds every sample that a rule of its table matches."""
    import re

    from stemquarry.operators import rules
    from stemquarry.plans import rule_queries as rq

    py = lambda p: re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), p))
    samples = [x for name in dir(rq) if name.startswith("_") and isinstance(getattr(rq, name), list) for x in getattr(rq, name) if isinstance(x, str)]
    samples += ["stati on", "govern ment", "th e", "monit or", "Taiw an", "wh ich", "w ith", "softw are", "runni ng", "togeth er", "vis ible", "import ance", "代號：1", "頁次 3", "\u2003\u2003", "\U00020000\U00020001"]
    for table, guard in ((rules.SPLIT_WORDS, rules.SPLIT_GUARD), *((t, rules.WIDE_GUARD) for t in (rules.HEADERS, rules.INSTRUCTIONS, rules.ENCODING, rules.PUNCTUATION, rules.TRUNCATED))):
        for k, p in table.items():
            if guard == rules.SPLIT_GUARD or p in rules._WIDE_PATTERNS:
                for x in samples:
                    if re.search(py(p).pattern, x, re.I if guard == rules.SPLIT_GUARD else 0):
                        assert py(guard).search(x), (k, x)


def test_ranges_of_few_values_are_balanced(spark):
    """A column of 100 values: the ranges go on within a value."""
    from pyspark.sql import functions as F

    from stemquarry.sources import corpus

    rows = spark.range(0, 400_000, 1, 8).select((F.col("id") % 100).alias("v"), F.xxhash64("id").alias("key"), F.lit("payload").alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in corpus.ordered_parts(rows, "v", "key").groupBy("_part").count().collect()]
        ids = corpus.dense_ids(rows, "n", "v", "key")
        got = ids.agg(F.count_distinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b")).first()
        moved = ids.orderBy("n").limit(5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 48 and max(sizes) < 3 * 400_000 / len(sizes)
    assert tuple(got) == (400_000, 1, 400_000) and [r.n for r in moved] == [1, 2, 3, 4, 5] and {r.v for r in moved} == {0}


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "double", "decimal(20,3)"])
def test_medians_equal_sorting(spark, kind):
    from pyspark.sql import functions as F

    from stemquarry.operators import reports

    top = {"tinyint": 100, "smallint": 30_000}.get(kind, 2_000_000_000)
    rows = spark.range(5000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 50 == 3, None).when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(2 * top)) - top).cast(kind).alias("v"))
    rows = rows.unionByName(spark.range(1).select(F.lit(9).cast("long").alias("g"), F.lit(None).cast(kind).alias("v")))
    by = {}
    for r in rows.where("v is not null").collect():
        by.setdefault(r.g, []).append(r.v)
    want = {g: sorted(v)[len(v) // 2] for g, v in by.items()}
    assert {r.g: r.upper_median for r in reports.upper_median(rows, "g", "v").collect()} == want
    assert {r.g: r.upper_median for r in reports.upper_median(rows, "g", "v", small_groups=True).collect()} == want


def test_median_of_a_large_group(spark):
    """Ten million rows of one group: each level is an aggregate that combines before the shuffle."""
    from pyspark.sql import functions as F

    from stemquarry.operators import reports

    n = 10_000_000
    rows = spark.range(0, n, 1, 8).select(F.lit("g").alias("g"), (F.col("id") * 7919 % n).alias("v"), (F.col("id") * 7919 % n / 3).alias("d"))
    assert reports.upper_median(rows, "g", "v").first().upper_median == n // 2
    assert reports.upper_median(rows, "g", "d").first().upper_median == pytest.approx(n // 2 / 3)


@pytest.mark.parametrize("options", [{}, {"slice_ids": 3}, {"met_ids": 20}, {"slice_ids": 2, "met_ids": 0}])
def test_best_matches_with_hot_keys(spark, options):
    """A key that all ids share, ids with very many keys, ties, string ids and an order of its own."""
    import random
    from collections import Counter

    from stemquarry.operators import joins

    r = random.Random(6)
    left = [(f"l{i}", f"k{r.randrange(40)}") for i in range(60) for _ in range(r.randint(1, 6))] + [(f"l{i}", "hot") for i in range(0, 60, 2)] + [("busy", f"k{k}") for k in range(40)] + [("alone", "none"), (None, "k1"), ("l1", None)]
    right = [(f"r{i}", f"k{r.randrange(40)}") for i in range(30) for _ in range(r.randint(1, 12))] + [(f"r{i}", "hot") for i in range(30)] + [("r9", None)]
    rank = {f"r{i}": i * 7 % 30 for i in range(30)}
    a, b = spark.createDataFrame(left * 2, "a string, k string"), spark.createDataFrame([(x, rank[x], k) for x, k in right], "b string, place int, k string")
    got = {x.a: (x.b, x.shared) for x in joins.best_match(a, b, "a", "b", ["k"], "place", **options).where("a is not null").collect()}
    keys = {}
    for x, k in set(right):
        if k is not None:
            keys.setdefault(k, []).append(x)
    want = {}
    for x in {x for x, _ in left if x is not None}:
        n = Counter(y for k in {k for z, k in left if z == x} for y in keys.get(k, ()))
        if n:
            y = min(n, key=lambda y: (-n[y], rank[y]))
            want[x] = (y, n[y])
    assert got == want
