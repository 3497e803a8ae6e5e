"""Operator 10: substring dedup by paragraph MinHash banding.

Paragraphs of a text are of two kinds.  Blocks are lines of at least ``min_words`` words, and runs of
shorter lines without a blank line between them that have as many together (wrapped text).  They are
compared as sets of 5-word shingles: MinHash signatures are cut into bands, as many and as wide as
``tuned_bands`` finds for the threshold and the wanted recall, and distinct blocks that collide in a
band are verified by exact Jaccard and clustered by connected components.  First every block is
compared with one hub of each of its bands, the block that collides most, which ties near copies of
one block together; in large bands the blocks outside the largest component also meet a few hubs of
that component.  Then bands whose blocks are still in different components are resolved:
their blocks outside the band's largest component meet all its blocks under exact bounds (sizes, and
bitmaps of shingles: a bit that one side lacks is a shingle that it lacks), so only pairs that may
reach the threshold become rows, once each.  So every colliding pair at the threshold is linked or in
one component already.
Passages that sit inside or across blocks are found by running paragraphs: runs of ``min_words``
words that start at content-chosen places, namely where a shingle's hash is the least of some
``spread`` successive ones (the last such place on ties).  A passage of at least
``min_words + spread - 1`` words that two texts share contains such a run in both, at whatever place
it stands.  Equal runs that overlap on one diagonal of a document and its keeper are one match,
which is extended word by word to its true ends.

The document with the smallest id of a cluster keeps its paragraph; it is removed from all others.
Only distinct blocks take part in banding, and every group is reduced to its first member by an
aggregate that combines before the shuffle, so common blocks and passages never form a task.

Words are maximal runs of non-blank bytes, with A-Z lower-cased.  Blocks are equal when 128-bit
hashes of their words are, runs by 64 bits, and a match counts only if 128-bit hashes of the whole
ranges in both documents agree; ``without_repeats`` cuts a range only from a text that has that hash
there.

Defined results: null, empty and short texts have no paragraphs and stay as they are; repeats within
one document stay; rows that share a doc_id count as one document; a null doc_id is left alone; of
ties the smaller id keeps; an empty table gives no rows; other columns, of whatever name, are carried
through by ``without_repeats`` and not read by ``repeats``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, connected_components, fresh, only_ids, ship
from .set_join import verified
from .textkernel import BLANK, Words, blocks, digests, mix, rolled, runs

MIN_WORDS = 25
SPREAD = 16
SHINGLE = 5
THRESHOLD = 80
#: Probability with which a pair exactly at the threshold collides in some band.
RECALL = 0.9998
#: Bands of a block at most.
MOST_BANDS = 12
#: Longs of a block's bitmap.
SKETCH = 16
#: Blocks from which a band is large: its blocks meet more hubs before they meet each other.
LARGE_BAND = 256
#: Hubs of the largest component that the other blocks of a large band meet.
HUBS = 8
#: Bytes of removed ranges that may be broadcast; beyond it the texts are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def tuned_bands(threshold: int = THRESHOLD, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the widest bands, which strangers collide in least, with which at most ``most``
    of them reach the recall at the threshold; one row each where none does."""
    found, rows = (most, 1), 1
    while (bands := max(1, math.ceil(math.log(1 - recall) / math.log1p(-((min(threshold, 99) / 100) ** rows))))) <= most:
        found, rows = (bands, rows), rows + 1
    return found


def anchors(value: np.ndarray, spread: int) -> np.ndarray:
    """The last position of the least value in each range of ``spread`` (a power of two) successive ones.

    Ranges that hold no value below the top are left out, as are positions with the top value.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low, at = value, np.arange(value.size)
    step = 1
    while step < spread:
        n = max(0, low.size - step)
        right = low[step:] <= low[:n]
        at = np.concatenate((np.where(right, at[step:], at[:n]), at[n:]))
        low = np.concatenate((np.minimum(low[step:], low[:n]), low[n:]))
        step *= 2
    return np.unique(at[low != top])


class Paragraphs:
    """Blocks (and running paragraphs) of the texts of a column, as word ranges."""

    def __init__(self, column: pa.Array, min_words: int = MIN_WORDS, spread: int = SPREAD, with_runs: bool = True):
        self.words = Words(column)
        self.shingle = rolled(self.words.hash, SHINGLE)
        self._blocks(min_words)
        if with_runs:
            self._runs(min_words, spread)

    def _blocks(self, min_words: int) -> None:
        w = self.words
        ends = np.flatnonzero(w.data == 10)
        edge = np.concatenate(([0], np.searchsorted(w.start, ends)))
        doc = np.searchsorted(w.doc_end, ends)
        size = np.diff(edge)
        short = (size > 0) & (size < min_words)
        on = np.zeros(size.size, bool)  # a short line behind a short line of its document
        on[1:] = short[1:] & short[:-1] & (doc[1:] == doc[:-1])
        begin = np.flatnonzero(~on)
        last = np.append(begin[1:], on.size) - 1 if begin.size else begin
        start, end = edge[:-1][begin], edge[1:][last]
        pick = end - start >= max(min_words, SHINGLE)
        self.block, self.block_end, self.block_doc = start[pick], end[pick], doc[begin][pick]
        self.block_key, self.block_check = digests(w.hash, self.block, self.block_end)

    def _runs(self, min_words: int, spread: int) -> None:
        w = self.words
        run_hash = rolled(w.hash, min_words)
        value = np.full(w.hash.size, 0xFFFFFFFFFFFFFFFF, np.uint64)
        doc = np.repeat(np.arange(w.count.size), w.count)
        at = np.arange(min(run_hash.size, self.shingle.size))
        at = at[at + min_words <= w.first[doc[: at.size] + 1]]
        value[at] = self.shingle[at] >> np.uint64(1)
        self.run = anchors(value, spread)
        self.run_hash, self.run_doc = run_hash[self.run], doc[self.run]
        # Equal runs that overlap (text that repeats itself) are one longer paragraph.
        on = np.zeros(self.run.size, bool)
        on[1:] = (self.run_hash[1:] == self.run_hash[:-1]) & (self.run_doc[1:] == self.run_doc[:-1]) & (np.diff(self.run) <= min_words)
        begin = np.flatnonzero(~on)
        last = np.append(begin[1:], on.size) - 1
        self.run_words = (self.run[last] - self.run[begin] + min_words) if begin.size else np.empty(0, np.int64)
        self.run, self.run_hash, self.run_doc = self.run[begin], self.run_hash[begin], self.run_doc[begin]

    def elements(self, i: int) -> np.ndarray:
        """Distinct shingles of one block."""
        return np.unique(self.shingle[self.block[i] : self.block_end[i] - SHINGLE + 1])

    def sketch(self, i: int) -> np.ndarray:
        """The bits that one block's shingles hash to."""
        place = (self.shingle[self.block[i] : self.block_end[i] - SHINGLE + 1] >> np.uint64(40)).astype(np.int64) % (64 * SKETCH)
        bits = np.zeros(64 * SKETCH, np.uint8)
        bits[place] = 1
        return np.packbits(bits, bitorder="little").view("<i8")

    def bands(self, n_bands: int, rows: int) -> np.ndarray:
        """(blocks, bands) keys from MinHash signatures of the blocks' shingles."""
        out = np.empty((self.block.size, n_bands), np.uint64)
        if not self.block.size:
            return out.astype(np.int64)
        seed = np.random.default_rng(20).integers(1, 1 << 62, n_bands * rows, dtype=np.uint64) | np.uint64(1)
        count = self.block_end - self.block - SHINGLE + 1
        first = np.concatenate(([0], np.cumsum(count)))
        x = self.shingle[np.repeat(self.block - first[:-1], count) + np.arange(first[-1])]
        with np.errstate(over="ignore"):
            for b in range(n_bands):
                key = np.full(count.size, b + 1, np.uint64)
                for r in range(rows):
                    least = np.minimum.reduceat((x * seed[b * rows + r]) >> np.uint64(20), first[:-1])
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
                out[:, b] = key
        return out.astype(np.int64)


def segments(docs: DataFrame, min_words: int, spread: int, n_bands: int, rows: int) -> DataFrame:
    """All paragraphs: key is the hash of the words; blocks carry a second hash and their band keys."""
    names = ["is_block", "key", "check", "doc_id", "start", "words", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            p = Paragraphs(block.column("text"), min_words, spread)
            ids = block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            first = p.words.first
            bands = pa.ListArray.from_arrays(pa.array(np.arange(p.block.size + 1, dtype=np.int32) * n_bands), pa.array(p.bands(n_bands, rows).ravel()))
            for kind, key, check, doc, start, words, bands in (
                (True, p.block_key, pa.array(p.block_check), p.block_doc, p.block, p.block_end - p.block, bands),
                (False, p.run_hash, pa.nulls(p.run.size, pa.int64()), p.run_doc, p.run, p.run_words, pa.nulls(p.run.size, pa.list_(pa.int64()))),
            ):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(key.size, kind)), pa.array(key.astype(np.int64)), check, pa.array(ids[doc]), pa.array(start - first[doc]), pa.array(words.astype(np.int64)), bands], names=names
                )

    return docs.select("doc_id", "text").mapInArrow(run, "is_block boolean, key long, check long, doc_id long, start long, words long, bands array<long>")


def _asked(docs: DataFrame, scratch: Scratch, wanted: DataFrame, name: str) -> DataFrame:
    """Texts of the documents of ``wanted(doc_id, asked)`` beside what is asked of each."""
    wanted = scratch.save(wanted, f"{name}-wanted")
    return only_ids(docs.select("doc_id", "text"), wanted.select("doc_id"), wanted.count()).join(wanted, "doc_id")


def _block_sets(docs: DataFrame, scratch: Scratch, needed: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, elements, sketch): the shingles of the blocks needed(key, low), by key; saved."""
    wanted = needed.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list("key").alias("asked"))  # at most the blocks of a document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            p = Paragraphs(block.column("text"), min_words, with_runs=False)
            place = dict(zip(zip(p.block_doc.tolist(), p.block_key.tolist(), strict=True), range(p.block.size), strict=True))
            found = [(key, place[doc, key]) for doc, keys in enumerate(block.column("asked").to_pylist()) for key in keys if (doc, key) in place]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), *(pa.array([of(i).astype(np.int64) for _, i in found], pa.list_(pa.int64())) for of in (p.elements, p.sketch))],
                names=["doc_id", "elements", "sketch"],
            )

    sets = _asked(docs, scratch, wanted, "blocks").mapInArrow(run, "doc_id long, elements array<long>, sketch array<long>")
    return scratch.save(sets.dropDuplicates(["doc_id"]), "block-sets")


def _near_blocks(docs: DataFrame, scratch: Scratch, firsts: DataFrame, min_words: int, threshold: int) -> DataFrame:
    """(a, b): keys of distinct blocks that reach the threshold, which tie all such blocks that collide
    in a band together."""
    bands = [c for c in firsts.columns if c.startswith("band")]
    spread = firsts.select("key", F.explode(F.array(*bands)).alias("band"))
    crowded = scratch.save(spread.groupBy("band").agg(F.count("*").alias("blocks")).where("blocks > 1"), "crowded")
    met = scratch.save(spread.join(crowded, "band"), "met")
    # The hub of a band: of its blocks, the one that meets most others in all its bands.
    weight = met.groupBy("key").agg(F.sum("blocks").alias("weight"))
    hubs = scratch.save(met.join(weight, "key").groupBy("band").agg(F.max_by("key", F.struct("weight", "key")).alias("hub")), "hubs")
    pairs = scratch.save(met.join(hubs, "band").where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), "hub-pairs")
    sets = _block_sets(docs, scratch, met.select("key").distinct().join(firsts.select("key", "low"), "key"), min_words)
    links = scratch.save(verified(pairs, sets, threshold), "hub-links")
    labels = connected_components(docs.sparkSession, scratch, links).withColumnRenamed("node", "key")
    scratch.drop(crowded, hubs, pairs)

    # Bands that still meet several components.
    bits = reduce(add, (F.bit_count(F.col("sketch")[i]) for i in range(SKETCH)))
    about = sets.select(F.col("doc_id").alias("key"), F.size("elements").cast("long").alias("n"), bits.alias("bits"), "sketch")
    known = _by_component(scratch, met, labels)
    large = scratch.save(known.where(F.col("blocks") >= LARGE_BAND).join(about, "key"), "large")
    hub = F.array_distinct(F.array(*[F.min_by("key", F.xxhash64("key", F.lit(s))) for s in range(HUBS)]))
    hubs = large.where("in_main").groupBy("band").agg(hub.alias("keys")).select("band", F.explode("keys").alias("key"))
    pairs = scratch.save(_meeting(large, large.join(hubs, ["band", "key"], "left_semi"), threshold).distinct(), "more-hub-pairs")
    if pairs.limit(1).count():
        links = scratch.save(links.union(verified(pairs, sets, threshold)), "all-hub-links")
        labels = connected_components(docs.sparkSession, scratch, links).withColumnRenamed("node", "key")
        scratch.drop(known)
        known = _by_component(scratch, met, labels)
    scratch.drop(met, large, pairs)
    rows = known.join(about, "key").join(firsts.select("key", *bands), "key")
    rows = scratch.save(rows.withColumn("at", F.array_position(F.array(*bands), F.col("band"))).drop("blocks"), "open")
    scratch.drop(known)
    earlier = reduce(or_, ((F.col("at_a") > i + 1) & (F.col(f"{c}_a") == F.col(f"{c}_b")) for i, c in enumerate(bands[:-1])), F.lit(False))
    rest = scratch.save(_meeting(rows, rows, threshold, ~earlier), "rest-pairs")
    scratch.drop(rows)
    more = scratch.save(verified(rest, sets, threshold), "rest-links")
    scratch.drop(rest, sets)
    return links.union(more)


def _by_component(scratch: Scratch, met: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, blocks, key, component, in_main) of the bands that meet several components; saved."""
    known = scratch.save(met.join(labels, "key", "left").select("band", "blocks", "key", F.coalesce("component", "key").alias("component")), "labelled")
    mixed = known.groupBy("band", "component").agg(F.count("*").alias("own")).groupBy("band").agg(
        F.max_by("component", F.struct("own", "component")).alias("main"), F.count("*").alias("components")
    )
    mixed = scratch.save(mixed.where("components > 1").drop("components"), "mixed")
    out = scratch.save(known.join(mixed, "band").withColumn("in_main", F.col("component") == F.col("main")).drop("main"), "known")
    scratch.drop(known, mixed)
    return out


def _meeting(left: DataFrame, right: DataFrame, threshold: int, also: Column | None = None) -> DataFrame:
    """(a, b): blocks outside the largest component of a band and others of the band, of different
    components, that the bounds leave."""
    side = lambda df, s, size: df.select("band", size.alias("size"), *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "band"))
    once = F.col("in_main_b") | (F.col("key_a") < F.col("key_b"))
    # A block meets those of its band whose size class holds sizes that it can reach the threshold with.
    least, most = F.ceil(F.col("n") * threshold / 100), F.floor(F.col("n") * 100 / threshold)
    outer = side(left.where("not in_main"), "a", F.explode(F.sequence(_size_class(least, threshold), _size_class(most, threshold))))
    met = outer.join(side(right, "b", _size_class(F.col("n"), threshold)), ["band", "size"]).where(once & (F.col("component_a") != F.col("component_b")) & _may_reach(threshold))
    met = met.where(also) if also is not None else met
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))


def _size_class(n: Column, threshold: int) -> Column:
    """Sizes in classes as wide as the threshold's ratio, so that partners lie in at most three; never falls as n grows."""
    return F.floor(F.log(n.cast("double")) / math.log(max(100 / threshold, 1.1))).cast("int")


def _may_reach(threshold: int) -> Column:
    """Exact bound for blocks a and b from sizes and bitmaps: a bit that only one bitmap has is a
    shingle that only that block has."""
    both = reduce(add, (F.bit_count(F.col("sketch_a")[i].bitwiseAND(F.col("sketch_b")[i])) for i in range(SKETCH)))
    most = both + F.least(*(F.col(f"n_{x}") - F.col(f"bits_{x}") for x in "ab"))
    sizes = F.col("n_a") + F.col("n_b")
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold) & (most * (100 + threshold) >= sizes * threshold)


def _matches(docs: DataFrame, scratch: Scratch, run_rows: DataFrame, min_words: int, spread: int) -> DataFrame:
    """(doc_id, keeper, start, end, core, core_end, hash, check): what a document shares with the first
    one that holds it, by equal runs, verified and extended to the true ends."""
    keepers = run_rows.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("high")).where("keeper <> high").select("key", "keeper")
    held = scratch.save(run_rows.join(scratch.save(keepers, "run-keepers"), "key"), "held-runs")
    kept = scratch.save(held.where("doc_id = keeper").groupBy("key").agg(F.min("start").alias("kept_start")), "kept-runs")
    placed = held.where("doc_id <> keeper").join(kept, "key").select("doc_id", "keeper", "start", "words", "kept_start").distinct()
    # Overlapping runs of one diagonal are one match; text that repeats itself matches by its first run.
    plain = placed.where(F.col("words") == min_words).withColumn("diagonal", F.col("start") - F.col("kept_start"))
    along = Window.partitionBy("doc_id", "keeper", "diagonal").orderBy("start")
    new = F.when(F.col("start") <= F.lag("start").over(along) + min_words, 0).otherwise(1)
    plain = plain.withColumn("new", new).withColumn("match", F.sum("new").over(along)).groupBy("doc_id", "keeper", "diagonal", "match").agg(
        F.min("start").alias("start"), (F.max("start") + min_words).alias("end"), F.min("kept_start").alias("kept_start")
    )
    matches = plain.select("doc_id", "keeper", "start", "end", F.col("end").alias("core_end"), "kept_start").unionByName(
        placed.where(F.col("words") > min_words).select("doc_id", "keeper", "start", (F.col("start") + F.col("words")).alias("end"), (F.col("start") + min_words).alias("core_end"), "kept_start")
    )
    matches = scratch.save(matches.withColumn("kept_end", F.col("kept_start") + F.col("core_end") - F.col("start")), "matches")
    scratch.drop(held, kept)

    own = matches.select("doc_id", F.struct("start", "core_end", "end").alias("r"))
    other = matches.select(F.col("keeper").alias("doc_id"), F.struct(F.col("kept_start").alias("start"), F.col("kept_end").alias("core_end"), F.col("kept_end").alias("end")).alias("r"))
    wanted = own.union(other).distinct().groupBy("doc_id").agg(F.collect_list("r").alias("asked"))  # at most the places of a document
    reach = spread - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            w = Words(block.column("text"))
            ids, rows = block.column("doc_id").to_pylist(), []
            for i, asked in enumerate(block.column("asked").to_pylist()):
                h = w.hash[w.first[i] : w.first[i + 1]].view(np.int64)
                rows += [(ids[i], r["start"], r["core_end"], r["end"], h[max(0, r["start"] - reach) : r["start"]][::-1], h[r["end"] : r["end"] + reach], i) for r in asked if r["end"] <= h.size]
            base = w.first[np.array([r[6] for r in rows], np.int64)]
            start, core = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), *map(pa.array, digests(w.hash, base + start, base + core)), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (4, 5))],
                names=["doc_id", "start", "core_end", "end", "hash", "check", "before", "after"],
            )

    schema = "doc_id long, start long, core_end long, end long, hash long, check long, before array<long>, after array<long>"
    context = scratch.save(_asked(docs, scratch, wanted, "matches").mapInArrow(run, schema).distinct(), "contexts")
    kept = context.select(F.col("doc_id").alias("keeper"), F.col("start").alias("kept_start"), F.col("core_end").alias("kept_end"), *(F.col(c).alias(f"kept_{c}") for c in ("hash", "check", "before", "after")))
    both = matches.join(context, ["doc_id", "start", "core_end", "end"]).join(kept, ["keeper", "kept_start", "kept_end"]).where("hash = kept_hash and check = kept_check")
    after = F.when(F.col("end") == F.col("core_end"), _common("after", "kept_after")).otherwise(0)
    out = both.select(
        "doc_id", "keeper", (F.col("start") - _common("before", "kept_before")).alias("start"), (F.col("end") + after).alias("end"), F.col("start").alias("core"), "core_end", "hash", "check"
    )
    out = scratch.save(out.distinct(), "removed-runs")
    scratch.drop(matches, context)
    return out


def _common(a: str, b: str) -> Column:
    """Number of equal elements from the front of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long"))


def removals(docs: DataFrame, scratch: Scratch, *, min_words: int = MIN_WORDS, spread: int = SPREAD, threshold: int = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, keeper, start, end, core, core_end, hash, check): word ranges to remove, the document
    that keeps each, and the hashes of the words from core to core_end."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    n_bands, rows = tuned_bands(threshold, recall)
    parts = scratch.save(segments(docs, min_words, spread, n_bands, rows), "segments")
    all_blocks = parts.where("is_block")
    # Two different blocks with one key, told apart by the second hash, are left alone.
    firsts = all_blocks.groupBy("key").agg(
        F.min("check").alias("check"), F.max("check").alias("other"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *(F.min(F.col("bands")[b]).alias(f"band{b}") for b in range(n_bands))
    )
    firsts = scratch.save(firsts.where("check = other").drop("check", "other"), "firsts")
    links = _near_blocks(docs, scratch, firsts, min_words, threshold)
    labels = connected_components(spark, scratch, links).withColumnRenamed("node", "key")
    clustered = scratch.save(firsts.join(labels, "key", "left").select("key", F.coalesce("component", "key").alias("component"), "low", "high"), "clustered")
    shared = scratch.save(
        clustered.groupBy("component").agg(F.min("low").alias("keeper"), F.max("high").alias("high")).where("keeper <> high").select("component", "keeper"), "shared"
    )
    keepers = scratch.save(clustered.join(shared, "component").select("key", "keeper"), "block-keepers")
    scratch.drop(firsts, clustered, shared)
    end = F.col("start") + F.col("words")
    removed = all_blocks.join(keepers, "key").where("doc_id <> keeper").select(
        "doc_id", "keeper", "start", end.alias("end"), F.col("start").alias("core"), end.alias("core_end"), F.col("key").alias("hash"), "check"
    )
    removed = scratch.save(removed.distinct(), "removed-blocks")
    matches = _matches(docs, scratch, parts.where("not is_block").select("key", "doc_id", "start", "words"), min_words, spread)
    scratch.drop(parts, keepers)
    return removed.unionByName(matches)


def _merged(removed: DataFrame, *keys: str) -> DataFrame:
    """Merged word ranges [start, end) in order, for each combination of keys (those of one document)."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = removed.select(*keys, "start", "end").distinct().withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(ordered))
    return (
        islands.groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    )


def repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keeper_id, ranges): what a document repeats of one with a smaller id.

    A row for each pair of a document and one that keeps passages it loses; ``ranges`` lists the
    merged word ranges start:end of these passages, comma-joined.  Documents that repeat nothing
    have no row.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    merged = _merged(removals(docs, scratch, **options), "doc_id", "keeper")
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    return merged.select("doc_id", F.col("keeper").alias("keeper_id"), text.alias("ranges"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; n_chars follows the text."""
    scratch = Scratch(docs.sparkSession, "passages")
    ranges_, id_ = (fresh(docs, c) for c in ("ranges", "removed_id"))
    fields = ("start", "end", "core", "core_end", "hash", "check")
    removed = removals(docs, scratch, **options).groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set(F.struct(*fields)).alias(ranges_))
    removed = scratch.save(removed, "removed")
    size = removed.agg(F.sum(F.size(ranges_) * 64 + 64)).first()[0] or 0
    joined = docs.join(F.broadcast(removed) if size <= BROADCAST_BYTES else removed, docs["doc_id"].cast("long") == F.col(id_), "left").drop(id_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ranges = block.column(ranges_)
            place = block.schema.get_field_index("text")
            out = block.drop_columns([ranges_])
            touched = np.flatnonzero(ranges.is_valid().to_numpy(zero_copy_only=False))
            if touched.size:
                text = block.column("text").to_pylist()
                w = Words(block.column("text"))
                for i in touched.tolist():
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    asked = [r for r in ranges[i].as_py() if r["end"] <= h.size]
                    own = digests(h, *(np.array([r[c] for r in asked], np.int64) for c in ("core", "core_end")))
                    sure = [r for r, a, b in zip(asked, *(x.tolist() for x in own), strict=True) if (a, b) == (r["hash"], r["check"])]
                    text[i] = cut(text[i], [(r["start"], r["end"]) for r in sure])
                out = out.set_column(place, out.schema.field(place), pa.array(text, out.schema.field(place).type))
            yield out

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def cut(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """A text without the given word ranges (which may overlap); the blank bytes behind a range go with it."""
    if not ranges:
        return text
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    start, _ = runs(~BLANK[data])
    start = np.append(start, len(raw))
    out, at = [], 0
    for a, b in sorted(ranges):
        if start[a] > at:
            out.append(raw[at : start[a]])
        at = max(at, int(start[min(b, start.size - 1)]))
    return b"".join([*out, raw[at:]]).decode()
