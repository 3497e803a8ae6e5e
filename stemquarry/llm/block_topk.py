"""Operator 7: exact top-k inner-product search by block-at-a-time pruning.

A vector is a document whose terms are its dimensions; component x weighs floor(256 * x).  The rows
of a group are laid out in ranges (blocks) of a fixed size, so that neighbours in a block resemble
each other.  For every block the index holds the largest and the smallest weight of each term, hence
for a query the sum over terms of ``max(q * largest, q * smallest)`` bounds every score in the
block; the block's centre and radius give a second bound, and the lesser one counts.  A query visits
blocks in descending order of that bound, scores each through the block's forward index (the dense
weights of its documents) and takes no block whose bound is below its k-th score.  Pruning is by
strict comparison, so ties, which go to the smaller id, are never lost.  The k-th score is carried
from block to block and from group to group: it starts as the k-th of a bounded sample of candidates.

Candidates are dealt into groups of bounded size and each is moved once; query packets follow their
group through one sorted partition and are streamed past its index, so no task holds more than one
group's index and one packet.  Each packet gives at most k rows for each query and group, and a
grouped top-k merges them.  This is the stated query set against all rows, in blocks.

Scores are exact: double arithmetic where all sums of a packet and a group stay below 2**53; beyond,
doubles with a bound of their rounding leave out the rows that can't be among the best, and the rest
is scored in 64-bit or Python's integers.  It is an error if a score that is returned doesn't fit the
result's 64-bit column; other products (a row with itself, rows that aren't among the best) may be of
any size.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
neither do weights beyond 64 bits (an error); repeated vectors are separate candidates; ids that
occur in several rows are candidates once for each row, and a query id that repeats is asked with
its least vector; a vector of another length than the query is no candidate for it; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, Scratch, ship

#: Weights per unit of a component.
SCALE = 256
#: Candidates of one group's index.
GROUP_ROWS = 65_536
#: Candidates of the sample that gives the first k-th scores.
SEED_ROWS = 2048
#: Queries whose products with a whole group are held at once, where sums may be too wide for doubles.
WIDE_QUERIES = 32
#: Blocks that a query scores in its own order before blocks are shared among queries.
OWN_BLOCKS = 4


def quantised(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, dims, data): floor(256 * x) of each component, of vectors that take part."""
    x = F.col(column)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    weight = lambda v: F.when(F.abs(v.cast("double")) < 2.0**54, F.floor(v.cast("double") * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a weight doesn't fit 64 bits")).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound).select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dims"), F.transform(x, weight).alias("data"))


def packets(vectors: DataFrame, rows: int, kind: type = np.int64) -> DataFrame:
    """(dims, ids, data): vectors packed ``rows`` at a time where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dims: int, parts: list, keep: int) -> Iterator[pa.RecordBatch]:
            ids, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = 0
            while ids.size - at > keep:
                to = at + rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dims], pa.int32()), pa.array([ids[at:to].tobytes()]), pa.array([data[at:to].tobytes()])],
                    names=["dims", "ids", "data"],
                )
                at = to
            held[dims] = [(ids[at:], data[at:])] if at < ids.size else []

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                pick = batch.filter(pa.array(dims == d))
                flat = pick.column("data").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                held.setdefault(int(d), []).append((ids[dims == d].astype(np.int64), flat))
                if sum(len(x) for x, _ in held[int(d)]) >= rows:
                    yield from packed(int(d), held[int(d)], rows - 1)
        for d, parts in list(held.items()):
            if parts:
                yield from packed(d, parts, 0)

    return vectors.mapInArrow(run, "dims int, ids binary, data binary")


def streamed(index: DataFrame, asked: DataFrame, groups: DataFrame, part: str, scratch: Scratch, search: Callable, schema: str) -> DataFrame:
    """Results of every query packet against every group of its dimension.

    ``index`` holds the rows of a group (group, dims, body), ``asked`` packets (dims, body) and
    ``groups`` the groups (group, dims).  Rows are sorted so that a group's rows come before its
    packets: each index row is moved once, each packet once for each group, and
    ``search(dims, index bodies, packets)`` sees the packets as a stream.
    """
    both = index.select(part, "dims", F.lit(0).alias("kind"), "body").unionByName(asked.join(groups, "dims").select(part, "dims", F.lit(1).alias("kind"), "body"))
    n = max(index.sparkSession.sparkContext.defaultParallelism, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bodies, ready = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                key, dims, kind, body = (batch.column(c)[i].as_py() for c in (part, "dims", "kind", "body"))
                if (key, dims) != at:
                    at, bodies, ready = (key, dims), [], None
                if kind == 0:
                    bodies.append(body)
                    continue
                if ready is None:
                    ready, bodies = search(dims, bodies), []
                yield from ready(body)

    return both.repartition(n, part, "dims").sortWithinPartitions(part, "dims", "kind").select(part, "dims", "kind", "body").mapInArrow(run, schema)


class BlockIndex:
    """Blocks of a group: forward weights, the largest and smallest weight of each term, centre and radius."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, block_rows: int = 32):
        order = self._layout(data.astype(np.float64), block_rows)
        self.ids, self.exact = ids[order], data[order]
        self.data = self.exact.astype(np.float64)
        self.largest = float(np.abs(self.data).max(initial=0.0))
        edge = np.arange(0, ids.size, block_rows)
        self.first = np.append(edge, ids.size)
        size = np.diff(self.first)
        self.most = np.maximum.reduceat(self.data, edge, axis=0)
        self.least = np.minimum.reduceat(self.data, edge, axis=0)
        self.centre = np.add.reduceat(self.data, edge, axis=0) / size[:, None]
        self.radius = np.sqrt(np.maximum.reduceat(((self.data - np.repeat(self.centre, size, axis=0)) ** 2).sum(axis=1), edge))
        self.scored = self.offered = 0  # pairs of query and document that were scored, and that there were

    @staticmethod
    def _layout(data: np.ndarray, block_rows: int) -> np.ndarray:
        """Halve a range along the line through two far points of it until it fits in a block."""
        out, stack = [], [np.arange(len(data))]
        while stack:
            rows = stack.pop()
            if rows.size <= block_rows:
                out.append(rows)
                continue
            x = data[rows]
            a = x[int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())]
            b = x[int(((x - a) ** 2).sum(axis=1).argmax())]
            rows = rows[np.argsort(x @ (b - a), kind="stable")]
            half = block_rows * max(1, rows.size // block_rows // 2)
            stack += [rows[half:], rows[:half]]
        return np.concatenate(out)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, blocks): no score of the block is larger (rounding is allowed for)."""
        by_terms = np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T
        by_ball = q @ self.centre.T + np.linalg.norm(q, axis=1)[:, None] * self.radius
        slack = 1e-9 * self.largest * np.abs(q).sum(axis=1, keepdims=True) + 1e-6
        return np.minimum(by_terms, by_ball) + slack

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query positions, ids, scores): the k best documents of each query that aren't its own row;
        those below the query's floor, a k-th score that is reached elsewhere, may be left out."""
        largest = float(np.abs(queries.astype(np.float64)).max(initial=0.0))
        width = largest * self.largest * queries.shape[1]
        if width >= 2.0**53:
            return self._wide(query_ids, queries, k, width)
        q = queries.astype(np.float64)
        n = len(q)
        best = np.full((n, k), -np.inf)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        kth = floors.astype(np.float64)  # at least this; never above the true k-th score
        bounds = self.bounds(q)
        self.offered += n * self.ids.size

        def take(who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
            """Merge scores (queries, documents) into the k best."""
            own = ids == query_ids[who][:, None]
            score = np.where(own, -np.inf, score)
            hit = (score >= kth[who][:, None]).any(axis=1)
            who, score, ids = who[hit], score[hit], np.broadcast_to(ids, score.shape)[hit]
            if not who.size:
                return
            score, ids = np.concatenate((best[who], score), axis=1), np.concatenate((best_id[who], ids), axis=1)
            ids = np.where(np.isneginf(score), np.iinfo(np.int64).max, ids)
            order = np.lexsort((ids, -score), axis=1)[:, :k]
            best[who], best_id[who] = np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)
            kth[who] = np.maximum(kth[who], best[who, -1])

        # First every query's best blocks in its own order, then the others, the best of any query first.
        ranked = np.argsort(-bounds, axis=1, kind="stable")[:, :OWN_BLOCKS]
        done = np.zeros(bounds.shape, bool)
        done[np.arange(n)[:, None], ranked] = True
        for turn in range(ranked.shape[1]):
            at = np.where(bounds[np.arange(n), ranked[:, turn]] >= kth, ranked[:, turn], -1)
            for b in np.unique(at[at >= 0]).tolist():
                self._score(np.flatnonzero(at == b), b, q, take)
        for b in np.argsort(-np.where(done, -np.inf, bounds).max(axis=0), kind="stable").tolist():
            self._score(np.flatnonzero((bounds[:, b] >= kth) & ~done[:, b]), b, q, take)
        who, place = np.nonzero(np.isfinite(best))
        return who, best_id[who, place], best[who, place].astype(np.int64)

    def _score(self, who: np.ndarray, b: int, q: np.ndarray, take: Callable) -> None:
        if who.size:
            s = slice(self.first[b], self.first[b + 1])
            self.scored += who.size * (s.stop - s.start)
            take(who, q[who] @ self.data[s].T, self.ids[s][None, :])

    def _wide(self, query_ids: np.ndarray, queries: np.ndarray, k: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of weights whose sums doubles can't hold: doubles with a bound of their error leave
        out the rows that can't be among them; the rest is scored in integers.

        Scores are Python integers where they may need more than 64 bits.
        """
        kind = np.int64 if width < 2.0**62 else object
        norm = np.linalg.norm(self.data, axis=1) if self.ids.size else np.empty(0)
        rounding = (queries.shape[1] + 8) * 2.0**-52
        self.offered += len(queries) * self.ids.size
        out = []
        for at in range(0, len(queries), WIDE_QUERIES):
            q = queries[at : at + WIDE_QUERIES].astype(np.float64)
            error = rounding * np.linalg.norm(q, axis=1)[:, None] * norm + 1.0
            score = q @ self.data.T
            other = self.ids != query_ids[at : at + len(q), None]
            lower = np.where(other, score - error, -np.inf)
            kth = -np.partition(-lower, k - 1, axis=1)[:, k - 1] if lower.shape[1] > k else np.full(len(q), -np.inf)
            for i in range(len(q)):
                maybe = np.flatnonzero(other[i] & (score[i] + error[i] >= kth[i]))
                self.scored += maybe.size
                exact = (self.exact[maybe].astype(kind) @ queries[at + i].astype(kind)).tolist()
                top = sorted(zip((-x for x in exact), self.ids[maybe].tolist(), strict=True))[:k]
                out += [(at + i, found, -lost) for lost, found in top]
        who, ids, scores = zip(*out, strict=True) if out else ((), (), ())
        return np.array(who, np.int64), np.array(ids, np.int64), np.array(scores, object)


def top_k(
    vectors: DataFrame,
    *,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    column: str = "embedding",
    group_rows: int = GROUP_ROWS,
    query_rows: int = 1024,
    block_rows: int = 32,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "topk")
    rows = quantised(vectors.select(id_col, column), id_col, column)
    shards = scratch.save(packets(rows, min(group_rows, 4096)).withColumn("shard", F.monotonically_increasing_id()), "shards")
    # A group is as many shards as fit; a small table has a group for each task.
    n_shards = shards.count()
    n_groups = max(1, math.ceil(n_shards / max(1, group_rows // 4096)), min(n_shards, spark.sparkContext.defaultParallelism))
    body = F.struct("ids", "data")
    grouped = shards.select(F.pmod(F.xxhash64("shard"), F.lit(n_groups)).cast("int").alias("group"), "dims", body.alias("body"))
    groups = scratch.save(grouped.select("group", "dims").distinct(), "groups")  # every packet goes to every group of its dimension
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    # The first k-th scores: of a bounded sample, any rows do.
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in shards.where(F.col("shard") % 2**33 == 0).limit(1).select("dims", F.expr(f"substring(ids, 1, {8 * SEED_ROWS})").alias("ids"), F.expr(f"substring(data, 1, {8 * SEED_ROWS} * dims)").alias("data")).collect():
        seeds[r["dims"]] = (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["data"], np.int64).reshape(-1, r["dims"]))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dims", "data")).alias("q"))
    asked = scratch.save(packets(queries.select("vec_id", "q.dims", "q.data"), query_rows).select("dims", body.alias("body")), "queries")

    def search(dims: int, bodies: list[dict]) -> Callable:
        ids = np.concatenate([np.frombuffer(b["ids"], np.int64) for b in bodies])
        data = np.concatenate([np.frombuffer(b["data"], np.int64).reshape(-1, dims) for b in bodies])
        index = BlockIndex(ids, data, block_rows)

        def ready(packet: dict) -> Iterator[pa.RecordBatch]:
            q_ids, q = np.frombuffer(packet["ids"], np.int64), np.frombuffer(packet["data"], np.int64).reshape(-1, dims)
            who, found, score = index.search(q_ids, q, floors_of(q_ids, q, seeds.get(dims), k), k)
            exact = score.tolist()
            fits = [-(1 << 63) <= x < 1 << 63 for x in exact]
            short = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(found), pa.array(short, pa.int64()), pa.array(fits, pa.bool_())], names=["query_id", "vec_id", "score", "fits"])

        return ready

    found = streamed(grouped, asked, groups, "group", scratch, search, "query_id long, vec_id long, score long, fits boolean")
    return merged(found, k)


def floors_of(query_ids: np.ndarray, queries: np.ndarray, seed: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """A k-th score that each query reaches among the sample, or minus infinity."""
    if seed is None or len(seed[0]) <= k or float(np.abs(queries).max(initial=0)) * float(np.abs(seed[1]).max(initial=0)) * queries.shape[1] >= 2.0**53:
        return np.full(len(queries), -np.inf)
    score = queries.astype(np.float64) @ seed[1].astype(np.float64).T
    score[query_ids[:, None] == seed[0][None, :]] = -np.inf
    return -np.partition(-score, k - 1, axis=1)[:, k - 1]


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all groups, ranked from 1; ties to the smaller id.

    Every group hands over at most k rows a query, and the sort key is one struct, so the grouped
    list is at most k times the number of groups long.
    """
    double = found.schema["score"].dataType.typeName() == "double"
    lost = -F.col("score") if double else F.bitwise_not("score")  # the least long has no negative
    # A score beyond 64 bits is cut to the last one that fits, above or below which it stands; one that is returned is an error.
    fits = F.lit(True) if double else F.col("fits")
    beyond = F.when(fits, 0).otherwise(F.when(F.col("score") > 0, -1).otherwise(1))
    score = None if double else F.when(F.col("hit.fits"), F.col("hit.score")).otherwise(F.raise_error(F.lit("an inner product doesn't fit 64 bits")).cast("long"))
    best = F.array_sort(F.collect_list(F.struct(lost.alias("lost"), beyond.alias("beyond"), "vec_id", "score", fits.alias("fits"))))
    return (
        found.groupBy("query_id")
        .agg(F.slice(best, 1, k).alias("best"))
        .select("query_id", F.posexplode("best").alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (F.col("hit.score") if double else score).alias("score"))
    )
