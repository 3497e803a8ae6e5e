"""Stateful streams, the table function for spans, and the data source for papers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stemquarry.functions import spans
from stemquarry.sources import pagesource, scratch
from stemquarry.streaming import sessions

HOUR = 3_600_000


# ---- streams ----


def runs_of(spark, root, parts, operator):
    """Rows that each run of one checkpoint adds."""
    seen, added = 0, []
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        sessions.to_the_end(operator(stream), f"{root}/out", f"{root}/checkpoint")
        n = spark.read.schema(operator(stream).schema).parquet(f"{root}/out").count()
        added.append(n - seen)
        seen = n
    return spark.read.schema(operator(stream).schema).parquet(f"{root}/out"), added


def test_sessions_end_an_hour_after_their_first_answer(spark, tmp_path):
    r = random.Random(4)
    rows = sorted((r.randrange(40 * HOUR), f"u{r.randrange(5)}", f"q{r.randrange(6)}", r.random() < 0.5) for _ in range(900))
    rows += [(50 * HOUR, "u9", "q0", True), (5, None, "q0", True), (7, "u1", None, None)]
    df = spark.createDataFrame(rows, "ms long, u string, q string, ok boolean").withColumn("at", F.timestamp_millis("ms"))
    late = spark.createDataFrame([(3, "u0", "q0", True)], "ms long, u string, q string, ok boolean").withColumn("at", F.timestamp_millis("ms"))
    parts = [df.where("ms < 13 * 3600000"), df.where("ms >= 13 * 3600000 and ms < 26 * 3600000"), df.where("ms >= 26 * 3600000").unionByName(late), df.where("false")]
    out, added = runs_of(spark, str(tmp_path), parts, lambda s: sessions.practice_sessions(s, "at", "u", "q", "ok"))
    by = {}
    for ms, u, q, ok in rows:
        if u is not None:
            by.setdefault(u, []).append((ms, q or "", bool(ok)))
    want = {(u, *sessions.scored(x)) for u, a in by.items() for x in sessions.split_sessions(a) if x[0][0] + HOUR < 48 * HOUR}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert all(added[:3]) and not added[3]  # each run goes on behind the last, and nothing comes twice


def test_first_requests_pass_once_over_restarts(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 40).alias("key"), F.timestamp_seconds(1000 + F.col("id")).alias("at"))
    out, added = runs_of(spark, str(tmp_path), [rows, rows.where("key < 20"), rows.withColumn("key", F.col("key") + 30)], lambda s: sessions.first_requests(s, "at", "key"))
    assert added == [40, 0, 30] and out.select("key").distinct().count() == out.count() == 70


def test_sessions_of_one_user():
    answers = [(0, "a", True), (10, "a", False), (HOUR - 1, "b", False), (HOUR, "a", True), (2 * HOUR + 5, "c", True)]
    assert [sessions.scored(s) for s in sessions.split_sessions(answers)] == [(0, 3, 2, 1), (HOUR, 1, 1, 1), (2 * HOUR + 5, 1, 1, 1)]
    assert sessions.split_sessions([]) == []


# ---- spans ----


def test_spans_of_many_patterns(spark):
    rules = {"word": "[a-zé中]+", "pair": "b c|c 中", "empty": "z*q"}
    texts = ["ab b c", None, "", "é中 c 中b zzq q", "none: 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    plain = {(i, k, m.start(), m.end(), m[0]) for i, t in enumerate(texts) if t for k, p in rules.items() for m in re.finditer(p, t)}
    assert {(r.id, r.rule, r.start, r.end, r.text) for r in spans.with_spans(df, "body", rules).collect()} == plain
    kept = sorted((r.id, r.start, r.end) for r in spans.with_spans(df, "body", rules, apart=True).collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(kept, kept[1:], strict=False)) and len(kept) < len(plain)


# ---- papers ----


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("papers")
    (root / "sub").mkdir()
    for i in range(12):
        (root / ("sub" if i % 2 else ".") / f"p{i:02}.html").write_text(f'<p lang="{"es" if i % 5 == 0 else "en"}">first {i}</p><li>a</li><li>b{i}</li>')
    (root / "_SUCCESS").write_text("")
    return root


def papers(spark, root, kind, **options):
    pagesource.register(spark)
    return spark.read.format("papers").option("decoder", f"stemquarry.plans.standin:{kind}").option("kind", kind).options(**options).load(str(root))


def test_a_folder_is_read_in_planned_partitions(spark, folder):
    rows = papers(spark, folder, "pages", partitionBytes="100")
    assert rows.rdd.getNumPartitions() == 4
    got = {r.path.rsplit("/", 1)[1]: (r.page, r.text, r.error) for r in rows.collect()}
    assert got["p01.html"] == (0, "first 1\na\nb1", None) and got["p05.html"] == (None, None, "ValueError: locked") and len(got) == 12
    assert papers(spark, folder, "pages", errors="drop").count() == 9
    assert [r.cells for r in papers(spark, folder, "tables").where(F.col("path").endswith("p03.html")).orderBy("row").collect()] == [["a", "1"], ["b3", "2"]]


def test_filters_on_the_path_reach_the_source(spark, folder, capsys):
    path = str(folder / "sub" / "p03.html")
    rows = papers(spark, folder, "words", partitionBytes="100").where(F.col("path") == path)
    rows.explain("formatted")
    assert "PushedFilters" in capsys.readouterr().out or rows.rdd.getNumPartitions() == 1
    assert {r.text for r in rows.collect()} == {"first", "3", "a", "b3"}
    assert papers(spark, folder, "words").where(F.col("path").isin("x", "y")).count() == 0


def test_wrong_options_fail_at_once(spark, folder):
    with pytest.raises(Exception, match="kind must be one of"):
        papers(spark, folder, "sounds").count()
    pagesource.register(spark)
    with pytest.raises(Exception, match="module"):
        spark.read.format("papers").option("decoder", "nothing.here:f").load(str(folder)).count()


def test_every_kind_has_its_columns(spark, folder):
    for kind in pagesource.KINDS:
        rows = papers(spark, folder, kind)
        assert rows.columns == [c.split()[0] for c in pagesource.schema_of(kind).split(", ")] and rows.where("error is not null").count() == 3


def test_shared_folders_need_a_shared_place(spark):
    assert scratch.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch.saved(spark.range(3)).count() == 3
