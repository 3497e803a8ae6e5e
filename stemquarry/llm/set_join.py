"""Operator 2: n-gram Jaccard join, size-aware (heavy-light).

A document's set holds its distinct k-word shingles as 64-bit hashes.  Documents with equal sets
are one class from the start (grouped by a 128-bit hash of the set), so copies are never paired.  Classes
link when ``100 * intersection >= threshold * union``.

Light sets (size at most a boundary) enumerate fixed-size subsets: two sets of sizes a and b link
exactly when they share c(a, b) elements, c = ceil(t (a + b) / (1 + t)), so each emits all its
subsets of every c that a partner size allows, and equal subset keys are links.  Heavy sets scan
inverted lists: under one global order of shingles, linked sets share an element among the first
``n - ceil(t n) + 1`` of each, so only those enter the lists.  Light sets near the boundary enter
them too, for their heavy partners.  The order is by hash, except that shingles which are common
in a sample of documents come last; any order is right, this one keeps lists short.  The boundary is
the one at which the estimated work of both sides is least, from the measured number of sets of each
size and the measured length of the lists that an entry meets.

Lists are resolved without pairing a group with itself.  First every class is compared with one
hub, the smallest class of its lists, which ties groups of near copies together.  Then pairs whose
members are still in different components are enumerated, list by list and size class by size
class, under exact bounds: sizes, the entries that can follow the first shared list, and the number
of lists shared; what is left is verified on whole sets, which are made once for each document of a
pair.  Hub links are only a shortcut: a pair that the second step leaves out is in one component
already.

Defined results: null text, empty text and text without words have an empty set, n_shingles 0 and
are linked with nothing (component_id is their own doc_id); fewer than k words are one shingle;
equal texts are linked; a repeated doc_id gives a row for each row, and its rows share one
component; a null doc_id takes part as a copy only (its component is that of an equal set, else
null); an empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, Scratch, connected_components, only_ids, ship
from .textkernel import blocks, digests, distinct_sets, mix

#: Documents of the sample that tells common shingles and list lengths; it grows with the square root
#: of the table beyond 4 million documents.
SAMPLE_DOCS = 4000
#: A shingle in at least this many documents of the sample comes last in the order.
COMMON_IN_SAMPLE = 4
#: The commonest shingles of the sample that the order knows, at most (8 bytes each in every task).
COMMON_KEYS = 1_000_000
#: Subset keys that one light set may emit; boundaries beyond that aren't considered.
LIGHT_KEYS = 50_000


def least_shared(a: int, b: int, t: int) -> int:
    """Smallest intersection with which sets of sizes a and b reach t percent."""
    return -(-t * (a + b) // (100 + t))


def partner_sizes(n: int, t: int) -> range:
    return range(-(-t * n // 100), 100 * n // t + 1)


def prefix_length(n: int, t: int) -> int:
    return n - -(-t * n // 100) + 1


def subset_sizes(n: int, boundary: int, t: int) -> list[int]:
    """Sizes c of the subsets that a light set of n elements emits."""
    return sorted({least_shared(n, b, t) for b in partner_sizes(n, t) if b <= boundary and least_shared(n, b, t) <= min(n, b)})


def light_work(n: int, boundary: int, t: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, boundary, t))


def chosen_boundary(sizes: dict[int, int], met: float, t: int) -> int:
    """The boundary of least work: subset keys of light sets against prefix entries of heavy ones.

    ``sizes`` counts sets by size, ``met`` is the number of other entries that one list entry meets.
    """
    heavy = lambda n: prefix_length(n, t) * (1 + met)
    best, least, b = 0, None, 0
    while b == 0 or light_work(b, b, t) <= LIGHT_KEYS:
        work = sum(m * (light_work(n, b, t) if n <= b else 0) + m * (heavy(n) if 100 * n // t > b else 0) for n, m in sizes.items())
        if least is None or work < least:
            best, least = b, work
        b += 1
    return best


def largest_light(t: int) -> int:
    """The largest boundary that is considered."""
    n = 1
    while light_work(n + 1, n + 1, t) <= LIGHT_KEYS:
        n += 1
    return n


def keys_of(x: np.ndarray, common: np.ndarray, boundary: int, t: int) -> np.ndarray:
    """List keys of one sorted set: subset keys if light, prefix elements if heavy or near heavy."""
    n = x.size
    out = []
    if n <= boundary:
        for c in subset_sizes(n, boundary, t):
            rows = np.array(list(combinations(range(n), c)), np.int64)
            with np.errstate(over="ignore"):
                out.append(mix(np.add.reduce(mix(x)[rows], axis=1, dtype=np.uint64) + np.uint64(c)))
    if 100 * n // t > boundary:
        if common.size:
            late = common[np.minimum(np.searchsorted(common, x), common.size - 1)] == x
            x = np.concatenate((x[~late], x[late]))
        out.append(x[: prefix_length(n, t)])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sets_table(docs: DataFrame, k: int, share: float) -> DataFrame:
    """(doc_id, n_shingles, set_hash, set_check, sample): ``sample`` holds the set itself for a share of the documents."""
    below = np.uint64(min(share, 1.0) * 0.999999 * 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = distinct_sets(block.column("text"), k)
            ids = block.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            chosen = (mix(ids + np.uint64(77)) <= below).tolist()
            size = np.array([s.size for s in sets], np.int64)
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(size),
                    *map(pa.array, digests(np.concatenate(sets), end - size, end)),
                    pa.array([s.astype(np.int64) if c and s.size else None for s, c in zip(sets, chosen, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_hash", "set_check", "sample"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash long, set_check long, sample array<long>")


def _plan(sets: DataFrame, n: int, t: int, sample_docs: int) -> tuple[np.ndarray, int]:
    """(common shingles, boundary) from the sampled sets, about ``sample_docs`` of n documents.

    The driver receives at most COMMON_KEYS shingles and a count for each small size.  They steer
    the order and the cost only, never the result.
    """
    seen = sets.where("sample is not null").dropDuplicates(["set_hash", "set_check"]).select(F.explode("sample").alias("key")).groupBy("key").count()
    common = seen.where(F.col("count") >= COMMON_IN_SAMPLE).orderBy(F.desc("count"), "key").limit(COMMON_KEYS).select("key").toPandas()["key"].to_numpy(np.int64)
    # Entries of the sample that a list entry meets, for shingles that aren't common, and in the whole table.
    met = seen.where(F.col("count") < COMMON_IN_SAMPLE).agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("met")).first()["met"] or 1.0
    met = (met - 1) * max(1.0, n / max(1, sample_docs))
    sizes = sets.where(F.col("n_shingles").between(1, 100 * (largest_light(t) + 1) // t)).groupBy("n_shingles").count()
    return np.sort(common.astype(np.uint64)), chosen_boundary({r["n_shingles"]: r["count"] for r in sizes.collect()}, met, t)


def _entries(docs: DataFrame, common: np.ndarray, boundary: int, k: int, t: int) -> DataFrame:
    """Inverted-list entries (key, doc_id, n), once for each distinct set of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)
            parts = [(keys_of(s, common, boundary, t), ids[i], s.size) for i, s in enumerate(distinct_sets(block.column("text"), k)) if s.size]
            if not parts:
                continue
            count = [p[0].size for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p[0] for p in parts]).astype(np.int64)),
                    pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), count)),
                    pa.array(np.repeat(np.array([p[2] for p in parts], np.int32), count)),
                ],
                names=["key", "doc_id", "n"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, n int")


def element_sets(docs: DataFrame, ids: DataFrame, n_ids: int, k: int) -> DataFrame:
    """(doc_id, elements): the whole sets of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = [s.astype(np.int64) for s in distinct_sets(block.column("text"), k)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "elements"])

    return only_ids(docs.select("doc_id", "text"), ids, n_ids).mapInArrow(run, "doc_id long, elements array<long>")


def verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) whose whole sets, from sets(doc_id, elements), link.

    The set of b travels to a: of hub pairs, where one a has many b, every set travels once.  Nothing
    above the second join needs the pairs of one a together, so Spark can split a hub's partition;
    where an id has several sets, a pair may come out more than once.
    """
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("of_b")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("of_a")), "a")
        .where((F.size("of_a") > 0) & ((100 + t) * both >= t * (F.size("of_a") + F.size("of_b"))))
        .select("a", "b")
    )


def pairs_across(scratch: Scratch, known: DataFrame, t: int, boundary: int) -> DataFrame:
    """(a, b): pairs of different components that share a list and can still link.

    ``known(key, doc_id, n, component)`` holds list entries: prefix elements of sets of n elements,
    and subset keys of sets up to the boundary.  In a list, the members outside its largest
    component meet all members; those inside it don't meet each other, so a large group of near
    copies costs no pairs of its own.  Lists are split by size class: sizes of a link differ by no
    more than a class.
    """
    mixed = known.groupBy("key", "component").agg(F.count("*").alias("own")).groupBy("key").agg(
        F.sum("own").alias("size"), F.max_by("component", F.struct("own", "component")).alias("main"), F.count("*").alias("components")
    )
    mixed = scratch.save(mixed.where("components > 1").drop("components"), "mixed")
    by_doc = Window.partitionBy("doc_id")
    ranked = known.join(mixed, "key").select(
        "key", "doc_id", "n", "component", (F.col("component") == F.col("main")).alias("in_main"),
        F.row_number().over(by_doc.orderBy("size", "key")).alias("rank"), F.count("*").over(by_doc).alias("entries"),
        F.floor(F.log(F.col("n")) / math.log(100 / t * 1.001)).cast("int").alias("class"),
    )
    open_lists = scratch.save(ranked, "open")
    scratch.drop(mixed)
    left, right = (
        open_lists.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "component", "in_main", "rank", "entries", "class"))) for side in "ab"
    )
    left = left.where("not in_main_a").withColumn("class", F.explode(F.sequence(F.col("class_a") - 1, F.col("class_a") + 1)))
    right = right.withColumnRenamed("class_b", "class")
    # Shortest lists first, the first list that a pair shares leaves at most the entries behind it.
    possible = 1 + F.least(F.col("entries_a") - F.col("rank_a"), F.col("entries_b") - F.col("rank_b"))
    once = F.col("in_main_b") | (F.col("doc_id_a") < F.col("doc_id_b"))
    swap = F.col("doc_id_a") > F.col("doc_id_b")
    ordered = lambda c, x, y: F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    pairs = (
        left.join(right, ["key", "class"])
        .where(once & (F.col("component_a") != F.col("component_b")) & _near("n_a", "n_b", t))
        .where(_enough_shared("n_a", "n_b", possible, boundary, t))
        .select(ordered("doc_id", "a", "b").alias("a"), ordered("doc_id", "b", "a").alias("b"), ordered("n", "a", "b").alias("n_a"), ordered("n", "b", "a").alias("n_b"))
        .distinct()
    )
    keys = open_lists.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # at most one prefix long
    rest = (
        pairs.join(keys.select(F.col("doc_id").alias("a"), F.col("keys").alias("keys_a")), "a")
        .join(keys.select(F.col("doc_id").alias("b"), F.col("keys").alias("keys_b")), "b")
        .where(_enough_shared("n_a", "n_b", F.size(F.array_intersect("keys_a", "keys_b")), boundary, t))
    )
    rest = scratch.save(rest.select("a", "b"), "rest")
    scratch.drop(open_lists)
    return rest


def _links(scratch: Scratch, docs: DataFrame, pairs: DataFrame, name: str, k: int, t: int) -> DataFrame:
    """The saved pairs that link."""
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    sets = scratch.save(element_sets(docs, ids, ids.count(), k), f"{name}-sets")
    links = scratch.save(verified(pairs, sets, t), f"{name}-links")
    scratch.drop(pairs, ids, sets)
    return links


def jaccard_components(docs: DataFrame, *, k: int = 5, threshold: int = 80, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; see the module docstring."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "setjoin")
    t = threshold
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs = docs.count()
    sample_docs = max(sample_docs, 2 * math.isqrt(n_docs))
    all_sets = scratch.save(_sets_table(docs, k, sample_docs / max(1, n_docs)), "sets")
    sets = all_sets.select("doc_id", "n_shingles", "set_hash", "set_check")
    same = ["set_hash", "set_check"]
    classes = scratch.save(sets.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # Rows that repeat another's set carry no list entries of their own.
    repeats = sets.where("n_shingles > 0").join(scratch.save(classes.where("copies > 1"), "copied"), same).where("doc_id <> rep").select("doc_id")
    repeats = scratch.save(repeats.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "repeats")
    common, boundary = _plan(all_sets, n_docs, t, sample_docs)
    first = docs.where("doc_id is not null")
    if repeats.count() <= BROADCAST_ROWS:
        entries = _entries(first.join(F.broadcast(repeats), "doc_id", "left_anti"), common, boundary, k, t)
    else:  # the list entries are moved, which are a fraction of the texts
        entries = _entries(first, common, boundary, k, t).join(repeats, "doc_id", "left_anti")
    entries = scratch.save(entries, "entries")

    lists = entries.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "n")).alias("hub")).where("size > 1")
    lists = scratch.save(lists.select("key", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("n_hub")), "lists")
    met = scratch.save(entries.join(lists, "key"), "met")
    scratch.drop(entries, lists)

    # One hub for each class: the one it shares most list entries with, if half of what a link needs.
    shared = met.where("doc_id <> hub").where(_near("n", "n_hub", t)).groupBy("doc_id", "hub", "n", "n_hub").agg(F.count("*").alias("s"))
    shared = shared.where(_enough_shared("n", "n_hub", 2 * F.col("s"), boundary, t))
    hubs = shared.groupBy("doc_id").agg(F.max_by("hub", F.struct("s", -F.col("hub"))).alias("hub"))
    links = _links(scratch, first, scratch.save(hubs.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), "hub-pairs"), "hub", k, t)
    labels = connected_components(spark, scratch, links)

    # Lists that still meet several components: every pair of them across components.
    known = met.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    known = scratch.save(known.select("key", "doc_id", "n", "component"), "known")
    scratch.drop(met)
    rest = pairs_across(scratch, known, t, boundary)
    scratch.drop(known)
    more = _links(scratch, first, rest, "rest", k, t)
    labels = connected_components(spark, scratch, links.union(more))
    scratch.drop(links, more)

    # Classes to documents; each class is one row, so a large class splits.
    classes = scratch.save(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component")), "labelled")
    return sets.join(classes, same, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _near(n: str, m: str, t: int) -> Column:
    return (F.col(n) * 100 >= F.col(m) * t) & (F.col(m) * 100 >= F.col(n) * t)


def _enough_shared(n: str, m: str, s: Column, boundary: int, t: int) -> Column:
    """Exact bound: of the set whose prefix ends first, all prefix entries but those that the other
    set may lack are shared, and a shared entry of that prefix is in the other prefix too."""

    def need(x: str, y: str) -> Column:
        prefix = F.col(x) - F.ceil(F.col(x) * t / 100) + 1
        lacking = F.col(x) - F.ceil((F.col(x) + F.col(y)) * t / (100 + t))
        return prefix - lacking

    return (F.greatest(n, m) <= boundary) | (s >= F.least(need(n, m), need(m, n)))
