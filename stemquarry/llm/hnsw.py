"""Operator 9: approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Rows are dealt to shards by a hash of the vector: as many as keep a shard at ``shard_rows`` rows on
average, whatever the cluster, so a table's result is always the same.  Each shard is one graph.  Every point is on
level 0 and, with a probability that falls geometrically, on higher levels.  Points are inserted
highest level first, in batches: each point of a batch descends through the graph built so far,
keeps a beam on every level, and is linked on its own levels to candidates of the beam (and of its
batch) that are chosen for diversity: a candidate is taken if it is nearer to the point than to the
links already taken.  Links run both ways; a point with too many keeps its oldest quarter, which
holds the long links made while the graph was sparse and so ties tight groups together, and a
diverse choice of the rest.  A graph is stored as flat arrays: vectors, row ids, and one neighbour
matrix per level.

A search starts at the entry point, descends with a small beam and keeps a wide one on level 0.  All
queries of a packet advance together, one array operation per expansion.  Every query visits every
shard: graphs are moved once, query packets are streamed past them, and the results of the shards
are merged by score.  Scores are cosines of the original vectors in double precision.

Rows with equal vectors share one point that carries their ids.  Only the k + 1 smallest of those
ids are kept, because a query returns at most k of them and skips at most its own row: results are
the same as with all of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part; rows with a null id neither; a query id that repeats is asked with its least vector; an id
that repeats with one vector is one candidate; vectors of another length are no candidates; ties go
to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .block_topk import merged, packets, streamed
from .runtime import Scratch, ship

#: Rows of a shard on average.
SHARD_ROWS = 16_384
#: Links that a point chooses (it holds twice as many on level 0).
LINKS = 20
#: Beam of an insertion on level 0.
BUILD_BEAM = 80
#: Beam of a search on level 0.
BEAM = 256
#: Beam on upper levels, and the points handed down to the next level.
UPPER_BEAM, HANDED = 32, 8
#: Beam points expanded by one step.
STEP = 6
#: Cells of the matrix that marks visited points: it bounds how many queries advance together.
VISITED_CELLS = 1 << 25


class Graph:
    """One shard: unit vectors and, per level, a matrix of neighbour positions (-1: none)."""

    def __init__(self, unit: np.ndarray, levels: list[np.ndarray], entry: int):
        self.unit, self.levels, self.entry = unit, levels, entry
        self.together = max(16, min(512, VISITED_CELLS // (len(unit) + 1)))
        self._seen = np.zeros((0, len(unit) + 1), bool)
        self.visited = 0  # points whose similarity was computed on level 0

    @classmethod
    def build(cls, unit: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 11) -> Graph:
        n = len(unit)
        height = np.minimum(np.random.default_rng(seed).exponential(1 / np.log(links), n), 8).astype(np.int64)
        order = np.argsort(-height, kind="stable")
        levels = [np.full((n, links * (1 + (level == 0))), -1, np.int32) for level in range(int(height.max()) + 1 if n else 0)]
        g = cls(unit, levels, int(order[0]) if n else 0)
        done = 0
        while done < n:
            batch = order[done : done + min(max(64, done // 2), g.together)]
            near = np.full((batch.size, 1), g.entry)
            for level in range(len(levels) - 1, -1, -1):
                ids, sims = np.empty((batch.size, 0), np.int64), np.empty((batch.size, 0), np.float32)
                if done:
                    ids, sims = g._beam(level, unit[batch], near, beam if level == 0 else UPPER_BEAM)
                    near = ids[:, :HANDED]
                mine = np.flatnonzero(height[batch] >= level)
                if mine.size:
                    g._link(level, batch[mine], ids[mine], sims[mine], links, beam)
            done += batch.size
        g._seen = g._seen[:0]
        g.visited = 0
        return g

    def _link(self, level: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int, beam: int) -> None:
        """Link new points of a level with their candidates, both ways."""
        near = self.levels[level]
        if new.size > 1:  # the other points of the batch are candidates too
            peers = self.unit[new] @ self.unit[new].T
            np.fill_diagonal(peers, -np.inf)
            c = min(new.size - 1, beam // 2)
            at = np.argpartition(-peers, c - 1, axis=1)[:, :c]
            ids, sims = np.concatenate((ids, new[at]), axis=1), np.concatenate((sims, np.take_along_axis(peers, at, axis=1)), axis=1)
        if not ids.shape[1]:
            return
        ids, _ = self._chosen(ids, sims, links, beam)
        near[new, : ids.shape[1]] = ids
        source, target = np.repeat(new, ids.shape[1]), ids.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        rows, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(target.size) - np.repeat(first, count)
        fits = place < links  # of a batch's links to one point, the first ones
        extra = np.full((rows.size, min(links, int(count.max(initial=0)))), -1, np.int64)
        extra[np.repeat(np.arange(rows.size), count)[fits], place[fits]] = source[fits]
        held = near[rows].astype(np.int64)
        extra[(extra[:, :, None] == held[:, None, :]).any(axis=2)] = -1
        both = np.concatenate((held, extra), axis=1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        width = near.shape[1]
        near[rows] = both[:, :width]
        full = np.flatnonzero((both >= 0).sum(axis=1) > width)
        old = width // 4
        for a in range(0, full.size, 1024):
            part = full[a : a + 1024]
            rest = both[part, old:]
            sims = np.where(rest >= 0, np.einsum("ijk,ik->ij", self.unit[rest], self.unit[rows[part]]), -np.inf)
            near[rows[part], old:] = self._chosen(rest, sims, width - old, rest.shape[1])[0]

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, take: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the best candidates, ``take`` for each row: diverse ones, then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :candidates]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        ids = np.where(np.isfinite(sims), ids, -1)
        taken = np.zeros(ids.shape, bool)
        for a in range(0, len(ids), 256):
            s = slice(a, a + 256)
            vectors = self.unit[ids[s]]
            between = vectors @ vectors.transpose(0, 2, 1)
            most = np.full(ids[s].shape, -np.inf, np.float32)  # similarity to the nearest link taken
            for j in range(ids.shape[1]):
                on = (most[:, j] < sims[s][:, j]) & (taken[s].sum(axis=1) < take) & (ids[s][:, j] >= 0)
                taken[s][on, j] = True
                most[on] = np.maximum(most[on], between[on, j])
        rank = np.argsort(np.where(taken, -1, np.where(ids >= 0, 0, 1)), axis=1, kind="stable")[:, :take]
        return np.take_along_axis(ids, rank, axis=1), np.take_along_axis(sims, rank, axis=1)

    def _beam(self, level: int, queries: np.ndarray, seeds: np.ndarray, beam: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """(positions, similarities), best first, of up to ``beam`` points near each query; -1 pads."""
        n, b = len(self.unit), len(queries)
        if len(self._seen) < b:
            self._seen = np.zeros((b, n + 1), bool)
        seen = self._seen[:b]
        seen[:] = False
        seen[:, n] = True  # the last column stands for padding
        near, every = self.levels[level], np.arange(b)[:, None]
        ids, sims, opened = np.full((b, beam), -1, np.int64), np.full((b, beam), -np.inf, np.float32), np.ones((b, beam), bool)
        s = min(beam, seeds.shape[1])
        ids[:, :s], opened[:, :s] = seeds[:, :s], seeds[:, :s] < 0
        sims[:, :s] = np.where(opened[:, :s], -np.inf, np.einsum("ijk,ik->ij", self.unit[seeds[:, :s]], queries))
        seen[every, seeds[:, :s]] = True
        step = min(step, beam)
        live = np.arange(b)
        while True:
            todo = np.where(opened[live], -np.inf, sims[live])
            pick = np.argpartition(-todo, step - 1, axis=1)[:, :step] if step < beam else np.broadcast_to(np.arange(beam), todo.shape)
            new = np.take_along_axis(todo, pick, axis=1) > -np.inf
            on = new.any(axis=1)
            live, pick, new = live[on], pick[on], new[on]
            if not live.size:
                break
            row = live[:, None]
            opened[row, pick] = True
            to = np.where(new[:, :, None], near[ids[row, pick]], -1).reshape(live.size, -1)
            to = np.sort(np.where(seen[row, to], -1, to), axis=1)
            to[:, 1:][to[:, 1:] == to[:, :-1]] = -1
            seen[row, to] = True
            to = to[:, np.flatnonzero((to >= 0).any(axis=0))]
            if not to.shape[1]:
                continue
            sim = np.where(to >= 0, np.einsum("ijk,ik->ij", self.unit[to], queries[live]), -np.inf)
            if level == 0:
                self.visited += int((to >= 0).sum())
            all_ids = np.concatenate((ids[live], to), axis=1)
            all_sims = np.concatenate((sims[live], sim.astype(np.float32)), axis=1)
            all_open = np.concatenate((opened[live], to < 0), axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], opened[live] = (np.take_along_axis(x, keep, axis=1) for x in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        return np.where(np.isfinite(sims), ids, -1), sims

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Positions, best first, of up to ``beam`` points near each unit query; -1 pads."""
        out = []
        for a in range(0, len(queries), self.together):
            q = queries[a : a + self.together]
            near = np.full((len(q), 1), self.entry)
            for level in range(len(self.levels) - 1, 0, -1):
                near = self._beam(level, q, near, UPPER_BEAM)[0]
            out.append(self._beam(0, q, near, beam)[0])
        return np.concatenate(out) if out else np.empty((0, beam), np.int64)


def _sound(column: str):
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


BODY = "struct<ids: binary, data: binary, graph: array<binary>>"


def build_index(vectors: DataFrame, scratch: Scratch, k: int, shard_rows: int) -> DataFrame:
    """One row per shard: (shard, dims, body), the body being ids, vectors, and the graph's flat arrays."""
    equal = Window.partitionBy("dims", "data").orderBy("vec_id")
    points = (
        vectors.withColumn("place", F.dense_rank().over(equal))
        .where(F.col("place") <= k + 1)  # bounded per vector, and applied before the shuffle too
        .groupBy("dims", "data")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )
    points = scratch.save(points, "points")
    n = points.count()
    shards = max(1, -(-n // shard_rows))
    points = points.withColumn("shard", F.pmod(F.xxhash64("data"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        x = _whole(table["data"]).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        graph = Graph.build(_unit(x))
        ids = _whole(table["ids"])
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))).astype(np.int64)
        widths = np.array([graph.entry, *(level.shape[1] for level in graph.levels)], np.int64)
        body = {"ids": flat.tobytes(), "data": x.tobytes(), "graph": [first.tobytes(), widths.tobytes(), *(level.tobytes() for level in graph.levels)]}
        types = pa.struct([("ids", pa.binary()), ("data", pa.binary()), ("graph", pa.list_(pa.binary()))])
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "dims": pa.array([dims], pa.int32()), "body": pa.array([body], types)})

    return scratch.save(points.groupBy("shard", "dims").applyInArrow(run, f"shard long, dims int, body {BODY}"), "index")


def nearest(
    vectors: DataFrame,
    *,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = 1024,
    beam: int = BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hnsw")
    rows = vectors.where(_sound(column) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.size(column).alias("dims"), F.col(column).cast("array<double>").alias("data")
    )
    index = build_index(rows, scratch, k, shard_rows)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dims", "data")).alias("q"))
    asked = packets(queries.select("vec_id", "q.dims", "q.data"), query_rows, np.float64)
    asked = scratch.save(asked.select("dims", F.struct("ids", "data", F.lit(None).cast("array<binary>").alias("graph")).alias("body")), "queries")

    def search(dims: int, bodies: list[dict]) -> Callable:
        (body,) = bodies
        x = np.frombuffer(body["data"]).reshape(-1, dims)
        ids, id_first, widths = (np.frombuffer(b, np.int64) for b in (body["ids"], *body["graph"][:2]))
        levels = [np.frombuffer(b, np.int32).reshape(len(x), w) for b, w in zip(body["graph"][2:], widths[1:].tolist(), strict=True)]
        graph = Graph(_unit(x), levels, int(widths[0]))
        norm = np.sqrt((x * x).sum(axis=1))

        def ready(packet: dict) -> Iterator[pa.RecordBatch]:
            q_ids, q = np.frombuffer(packet["ids"], np.int64), np.frombuffer(packet["data"]).reshape(-1, dims)
            out = []
            for j, points in enumerate(graph.search(_unit(q), min(beam, max(1, len(x))))[:, : 4 * k + 4]):
                points = points[points >= 0]
                score = (x[points] @ q[j]) / (norm[points] * np.sqrt((q[j] * q[j]).sum()))
                own = np.concatenate([ids[id_first[p] : id_first[p + 1]] for p in points])
                score = np.repeat(score, id_first[points + 1] - id_first[points])
                keep = own != q_ids[j]
                own, score = own[keep], score[keep]
                best = np.lexsort((own, -score))[:k]
                out.append((np.full(best.size, q_ids[j]), own[best], score[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        return ready

    return merged(streamed(index, asked, index.select("shard", "dims"), "shard", scratch, search, "query_id long, vec_id long, score double"), k)
