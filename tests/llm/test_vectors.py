"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemquarry.llm import block_topk, hnsw

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, score string, dims string, shard string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(40)]  # one vector many times
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (450, [0.0] * 8), (None, [1.0] * 8), (500, [1.0, 2.0]), (501, [1.0, 2.0]), (50, rows[50][1])]
    return spark.createDataFrame([(*x, "a", "b", "c", "d") for x in rows], SCHEMA).repartition(3), rows


def plain(rows, every, k, score, usable):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v)).all() and usable(v)]
    out = {}
    for q, x in rows:
        if q % every == 0:
            best = sorted(((-score(x, y), i) for i, y in rows if i != q and len(y) == len(x)))[:k]
            out.setdefault(q, []).append([(i, -s) for s, i in best])
    return out


def test_exact_top_k(odd):
    df, rows = odd
    want = plain(rows, 50, 5, lambda x, y: int((np.floor(256 * x) * np.floor(256 * y)).sum()), lambda v: True)
    got = {}
    for r in block_topk.top_k(df, group_rows=64, query_rows=3, block_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, lists in want.items():
        if len(lists) == 1:
            assert got.get(q, []) == [(n, i, s) for n, (i, s) in enumerate(lists[0], 1)], q


def test_exact_top_k_on_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = plain(rows, 50, 5, lambda x, y: int((np.floor(256 * x) * np.floor(256 * y)).sum()), lambda v: True)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in block_topk.top_k(df, group_rows=100).orderBy("query_id", "rank").collect()]
    assert got == [(q, n, i, s) for q in sorted(want) for n, (i, s) in enumerate(want[q][0], 1)]


def test_blocks_are_pruned():
    r = np.random.default_rng(1)
    centre = r.integers(-100, 100, (16, 32))
    data = np.repeat(centre, 64, axis=0) + r.integers(-3, 3, (1024, 32))
    index = block_topk.BlockIndex(np.arange(1024), data, 64)
    who, ids, scores = index.search(np.arange(1024), data, np.full(1024, -np.inf), 5)
    assert index.scored < 0.3 * index.offered
    for q in range(0, 1024, 100):
        best = sorted((-int(data[q] @ data[i]), i) for i in range(1024) if i != q)[:5]
        assert sorted(zip((-scores[who == q]).tolist(), ids[who == q].tolist())) == best


def test_floors_prune_and_lose_nothing():
    r = np.random.default_rng(2)
    data, ids = r.integers(-300, 300, (900, 16)), np.arange(900)
    q_ids, q = ids[::30], data[::30]
    floors = block_topk.floors_of(q_ids, q, (ids[:200], data[:200]), 5)
    kept = 0
    found = {int(i): [] for i in q_ids}
    for part in (slice(0, 450), slice(450, 900)):
        index = block_topk.BlockIndex(ids[part], data[part], 8)
        who, got, score = index.search(q_ids, q, floors, 5)
        kept += index.offered - index.scored
        for w, i, s in zip(who.tolist(), got.tolist(), score.tolist()):
            found[int(q_ids[w])].append((-s, i))
    assert kept > 0
    for i, x in zip(q_ids.tolist(), q):
        assert sorted(found[i])[:5] == sorted((-int(x @ data[j]), j) for j in range(900) if j != i)[:5]


@pytest.mark.parametrize("size", [1e3, 2e7, 9.5e7])
def test_scores_are_exact_at_any_size(spark, size):
    """Sums beyond what doubles hold, in 64-bit integers and in Python's, with ties and near ties."""
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(r.normal(size=3) * size / 50)]) for i in range(60)] + [(60 + i, [size / 60, 1.0 * i, 2.0]) for i in range(40)] + [(100, [size / 60, 5.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain([(i, v) for i, v in rows], 50, 5, lambda x, y: 0, lambda v: True)
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    got = {}
    for x in block_topk.top_k(df, group_rows=4096, block_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    for q in want:
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in best]


def test_only_a_returned_score_must_fit(spark):
    """Products with the own row, and those that aren't among the best, may be of any size."""
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(200)]
    rows[50] = (50, [3e8, 1.0, 0.0, -2.0])  # a query: its own product is 5.9e21
    rows[7] = (7, [1e5, -1e5, 5.0, 0.5])
    rows[100] = (100, [2.5e8, -3e8, 0.5, 0.25])  # another query, whose products with 50 and 150 don't fit
    rows[150] = (150, [-3e8, -3e8, 1.0, 1.0])
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))
    assert dot(100, 50) > 2**63 and dot(50, 50) > 2**63 and dot(50, 150) < -(2**63)
    frame = lambda some: spark.createDataFrame(some, "vec_id long, embedding array<double>")
    fit = [x for x in rows if x[0] not in (100,)]
    got = {}
    for x in block_topk.top_k(frame(fit), group_rows=4096, block_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    for q in (0, 50, 150):
        best = sorted((-dot(q, i), i) for i, _ in fit if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in best]
    with pytest.raises(Exception, match="doesn't fit 64 bits"):
        block_topk.top_k(frame(rows)).collect()
    few = block_topk.top_k(frame([rows[50], rows[7], rows[150]]))  # every product is returned
    with pytest.raises(Exception, match="doesn't fit 64 bits"):
        few.collect()


def test_wide_rows_leave_most_others_unscored():
    r = np.random.default_rng(5)
    data = (r.normal(size=(2000, 16)) * 3e9).astype(np.int64)
    index = block_topk.BlockIndex(np.arange(2000), data, 32)
    who, ids, scores = index.search(np.arange(0, 2000, 50), data[::50], np.full(40, -np.inf), 5)
    assert index.scored < 0.01 * index.offered
    for q in range(40):
        best = sorted((-sum(int(a) * int(b) for a, b in zip(data[50 * q], data[i])), i) for i in range(2000) if i != 50 * q)[:5]
        assert [(-s, i) for s, i in zip(scores[who == q].tolist(), ids[who == q].tolist())] == best


def test_graph_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    cosine = lambda x, y: float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
    want = plain(rows, 50, 5, cosine, any)
    got = {}
    for r in hnsw.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want)
    assert hits >= 0.95 * sum(len(want[q][0]) for q in want)
    by = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(cosine(np.array(by[q]), np.array(by[i])), abs=1e-12)


def recall(unit, beam=hnsw.BEAM, every=20, k=5):
    """(recall, share of the points visited) of one graph at production parameters."""
    graph = hnsw.Graph.build(unit)
    q = np.arange(0, len(unit), every)
    found = graph.search(unit[q], beam)
    hits = 0
    for i, row in zip(q, found):
        s = unit @ unit[i]
        s[i] = -np.inf
        hits += len(set(row[row != i][:k].tolist()) & set(np.argpartition(-s, k)[:k].tolist()))
    return hits / (k * q.size), graph.visited / (q.size * len(unit))


def test_graph_of_a_large_shard_and_of_tight_groups():
    r = np.random.default_rng(5)
    found, visited = recall(hnsw._unit(r.normal(size=(16_000, 64))), every=100)
    assert found >= 0.95 and visited < 0.4
    for size in (60, 200):
        centre = np.repeat(r.normal(size=(4000 // size, 64)), size, axis=0)
        assert recall(hnsw._unit(centre + 0.05 * r.normal(size=centre.shape)))[0] >= 0.99


def test_graph_edges(odd, spark):
    df, rows = odd
    want = plain(rows, 50, 5, lambda x, y: float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), any)
    got = {}
    for r in hnsw.nearest(df, shard_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and got[50] == [300, 301, 302, 303, 304] and got[500] == [501] and 450 not in got
    hits = sum(len(set(got[q]) & {i for i, _ in want[q][0]}) for q in want)
    assert hits >= 0.9 * sum(len(want[q][0]) for q in want)
    none = spark.createDataFrame([], SCHEMA)
    assert hnsw.nearest(none).count() == 0 and block_topk.top_k(none).count() == 0
    assert hnsw.nearest(df.where(F.col("vec_id") == 50)).count() == 0
