"""The pipeline stage by stage: what each keeps, cuts and packs."""

import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from stemquarry.llm import quality_crf, secret_dfa

from .test_documents import brute_components, brute_secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_stage(spark, stages):
    model = quality_crf.fit_model(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_crf.score_documents(stages[0], model).collect()}
    assert set(rows(stages[1])) == {d for d, s in scores.items() if s >= 0.3}


def test_near_duplicate_stage(stages):
    before = rows(stages[1])
    groups = brute_components([(d, r.text) for d, r in before.items()])
    assert set(rows(stages[2])) == {d for d, (_, c) in groups.items() if c == d}


def test_passage_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    words = lambda t: re.findall(r"\S+", t)
    seen = {}
    for d in sorted(after):
        w = words(after[d].text)
        for i in range(len(w) - 49):
            assert seen.setdefault(tuple(w[i : i + 50]), d) == d
        assert after[d].n_chars == len(after[d].text) or after[d].text == before[d].text


def test_secret_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert not brute_secrets(r.text)
        if not brute_secrets(before[d].text) and r.text != before[d].text:
            assert "[secret]" in r.text
    assert secret_dfa.secrets(stages[4]).where("n_spans > 0").count() == 0


def test_packing_stage(stages):
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == set(rows(stages[4]))
    total = {r.doc_id: r.doc_tokens for r in packed}
    assert sum(r.length for r in packed) == sum(total.values())


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    total = lambda df: {r.doc_id: (r.doc_tokens, r.n) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()}
    assert total(got) == total(stages[5]) and all(a == b for a, b in total(got).values())


def test_repeated_ids_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, None, "en", "s", 0), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_first_copies(spark, docs, SF)
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]


def test_texts_that_share_an_id_are_not_lost(spark):
    texts = ["a b c d e f", "quite another text of one id", "a b c d e f", None]
    docs = spark.createDataFrame([(1, t, "en", "s", 1) for t in texts] + [(2, "quite another text of one id", "en", "s", 1), (2, "and one more text of two", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_first_copies(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted({(1, t) for t in texts}, key=str)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "password = abcdefghijklmnop"), (6, " ".join(f"w{i % 4999}" for i in range(30_000))), (6, "short"), (7, "one two"), (None, "null id")]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_tables(spark, number):
    """Nulls, empty and very long texts, ties, repeated ids, clashing names of odd types, and no rows."""
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars int")
    for c in ("_place", "quality_score", "component_id", "ranges", "removed_id", "key", "row", "n"):
        docs = docs.withColumn(c, F.create_map(F.lit("a"), F.lit(1)) if c in ("_place", "row") else F.lit("own"))
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert name == "packing" or out.columns == docs.columns
    ids = [r.doc_id for r in rows]
    if name == "near_duplicates":
        assert sorted(ids, key=str) == [1, 2, 3, 4, 5, 6, 6, None] and all(r._place == {"a": 1} and r.key == "own" for r in rows)
    elif name != "quality":
        assert set(ids) == {i for i, _ in ODD}
    texts = {r.doc_id: r.text for r in rows if name not in ("quality", "packing")}
    if texts:
        assert texts[1] is None and texts[2] == "" and (texts[5] == "[secret]") == (name == "secrets")
    assert stage(spark, docs.where("false"), SF).count() == 0
