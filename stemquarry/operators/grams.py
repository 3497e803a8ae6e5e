"""Substring search by character n-grams: an index for keywords, and containment joins without a key.

A gram of n characters is a number.  Grams come from Arrow batches in whole-array passes; what they
find is always verified on the texts, so they only have to miss nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import search

#: Ids that one row of the posting lists may hold: a row is the ids of a gram within a range of so many ids.
BUCKET_IDS = 1 << 16
#: Ids that a search may bring to the driver to read only the row groups that hold them; beyond it the ids are joined.
FETCHED_IDS = 10_000
#: Grams of phrases that the tasks may hold to leave out other grams of the texts (8 bytes each).
HELD_GRAMS = 2_000_000
#: Gram lengths of a containment join: a phrase uses the longest that it has.
SIZES = (8, 3, 1)
#: Characters that are cut into grams at once.
_CHARACTERS = 1 << 20


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, characters, text index of each character; -1 behind each text) of runs of (id, text) rows."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n < _CHARACTERS):
                n += len(texts[to] or "") + 1
                to += 1
            part = [t or "" for t in texts[at:to]]
            size = np.fromiter((len(t) + 1 for t in part), np.int64, len(part))
            chars = np.frombuffer("\0".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            owner = np.repeat(np.arange(len(part)), size)
            owner[np.cumsum(size) - 1] = -1
            yield ids[at:to], chars, owner
            at = to


def _places(owner: np.ndarray, n: int) -> np.ndarray:
    """Starts of the grams of n characters that lie in one text."""
    if owner.size < n:
        return np.empty(0, np.int64)
    gap = np.concatenate(([0], np.cumsum(owner < 0)))
    return np.flatnonzero(gap[n:] == gap[:-n])


def _distinct(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))) if gram.size else np.empty(0, bool)
    return gram[new], owner[new]


# ---- keyword index ----


def _spelled(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Two or three characters as one number; those of two are negative."""
    c = chars.astype(np.int64)
    pair = (c[at] << 21) | c[at + 1]
    return -1 - pair if n == 2 else (pair << 21) | c[at + 2]


def postings(texts: DataFrame, key: str, *columns: str) -> DataFrame:
    """(gram, bucket, ids): the rows that hold each gram of two and of three lower-case characters in any column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chars, owner in _runs(batches):
            parts = [(_spelled(chars, at, n), owner[at]) for n in (2, 3) for at in [_places(owner, n)]]
            gram, doc = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            own = ids[doc].astype(np.int64)
            order = np.lexsort((own, gram))
            gram, own = gram[order], own[order]
            bucket = own // BUCKET_IDS
            edge = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (bucket[1:] != bucket[:-1])))) if gram.size else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(edge, gram.size).astype(np.int32)), pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(gram[edge]), pa.array(bucket[edge]), lists], names=["gram", "bucket", "ids"])

    rows = texts.select(F.col(key).cast("long"), F.lower(F.concat_ws("\0", *columns)))
    found = rows.where(F.col(key).isNotNull()).mapInArrow(run, "gram long, bucket long, ids array<long>")
    return found.groupBy("gram", "bucket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))  # at most BUCKET_IDS


@dataclass
class KeywordIndex:
    """A table in order of its ids and the posting lists of its texts."""

    rows: DataFrame
    lists: DataFrame
    key: str
    columns: tuple[str, ...]


def write_index(rows: DataFrame, path: str, key: str, columns: tuple[str, ...], block_bytes: int = 4 << 20) -> KeywordIndex:
    """FIL-05: write both tables, each in the order it is looked up by, so that few row groups are read for a keyword."""
    spark = rows.sparkSession
    ordered = lambda df, *by: df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", block_bytes)
    ordered(rows, key).parquet(f"{path}/rows")
    ordered(postings(rows, key, *columns), "gram", "bucket").parquet(f"{path}/postings")
    return open_index(spark, path, key, columns)


def open_index(spark: SparkSession, path: str, key: str, columns: tuple[str, ...]) -> KeywordIndex:
    return KeywordIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/postings"), key, tuple(columns))


def keyword_grams(text: str, wildcards: bool = False) -> list[int]:
    """Grams that a row with the lower-case keyword must hold; none if no part has two characters."""
    parts = text.replace("%", "\0").replace("_", "\0").split("\0") if wildcards else [text]
    out = set()
    for p in parts:
        if len(p) > 1:
            chars = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
            out |= set(_spelled(chars, np.arange(len(p) - min(3, len(p)) + 1), min(3, len(p))).tolist())
    return sorted(out)


def candidates(index: KeywordIndex, text: str, wildcards: bool = False) -> DataFrame | None:
    """(key) of the rows that hold all grams of the keyword; None where it has no gram (then all rows are)."""
    lowered = index.lists.sparkSession.range(1).select(F.lower(F.lit(text)).alias("t")).first()["t"]
    grams = keyword_grams(lowered, wildcards)
    if not grams:
        return None
    met = index.lists.where(F.col("gram").isin(grams)).groupBy("bucket").agg(F.collect_list("ids").alias("lists"))
    rest = F.slice("lists", F.lit(2), F.size("lists") - 1)
    common = F.aggregate(rest, F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return met.where(F.size("lists") == len(grams)).select(F.explode(common).alias(index.key))


def indexed_rows(index: KeywordIndex, text: str, wildcards: bool = False, fetched: int = FETCHED_IDS) -> DataFrame:
    """FIL-05: the rows whose text columns hold the keyword, as a scan finds them.

    Up to ``fetched`` candidates become a filter on ids, which is pushed into the scan and skips row
    groups; more of them are joined.
    """
    found = candidates(index, text, wildcards)
    rows = index.rows
    if found is not None:
        ids = [r[0] for r in found.limit(fetched + 1).collect()]
        rows = rows.where(F.col(index.key).isin(ids)) if len(ids) <= fetched else rows.join(found, index.key, "left_semi")
    return rows.where(search.keyword(text, index.columns, wildcards))


def indexed_search(index: KeywordIndex, files: DataFrame, text: str, *, wildcards: bool = False, **options) -> DataFrame:
    """FIL-05, JOI-01, ORD-01, PRJ-05: ``search.search`` over the rows that the index gives."""
    return search.search(indexed_rows(index, text, wildcards), files, text, wildcards=wildcards, text_columns=index.columns, **options)


# ---- containment without a key ----


def _mixed(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n characters from each place."""
    with np.errstate(over="ignore"):
        h = np.full(at.size, n, np.uint64)
        for k in range(n):
            h = (h ^ chars[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(32))).view(np.int64)


def _grams_of(rows: DataFrame, key: str, text: str, sizes: tuple[int, ...], longest_only: bool, held=None) -> DataFrame:
    """(gram, key): distinct grams of each text; of the longest size it has only, or of all sizes, or those held only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = held.value if held is not None else None
        for ids, chars, owner in _runs(batches):
            size = np.bincount(owner[owner >= 0], minlength=ids.size)
            parts = []
            for k, n in enumerate(sizes):
                at = _places(owner, n)
                if longest_only and k:
                    at = at[size[owner[at]] < sizes[k - 1]]
                gram = _mixed(chars, at, n)
                if some is not None and some.size:
                    known = some[np.minimum(np.searchsorted(some, gram), some.size - 1)] == gram
                    gram, at = gram[known], at[known]
                parts.append((gram, owner[at]))
            gram, doc = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ids[doc])], names=["gram", key])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(run, f"gram long, `{key}` {kind}")


def contained_anywhere(phrases: DataFrame, texts: DataFrame, phrase_id: str, phrase: str, text_id: str, text: str, held_grams: int = HELD_GRAMS) -> DataFrame:
    """JOI-14, CMP-05, TXT-33: (phrase_id, text_id) of every text that holds a phrase, without a shared key.

    A phrase probes the texts with its rarest gram: it is in no text that lacks one of its grams.  The
    pairs that share it are verified on phrase and text.  Both sides of the join on grams are written
    tables, so Spark splits the partition of a gram that very many texts hold.  Empty and null phrases
    are in no result; ids identify rows.
    """
    spark = phrases.sparkSession
    some = phrases.where(F.length(phrase) > 0)
    own = saved(_grams_of(some, phrase_id, phrase, SIZES, True), "phrase-grams")
    keys = own.select("gram").distinct()
    held = None
    if own.limit(held_grams + 1).count() <= held_grams:
        held = spark.sparkContext.broadcast(np.sort(keys.toArrow().column("gram").to_numpy()))
    there = saved(_grams_of(texts, text_id, text, SIZES, False, held), "text-grams")
    counts = there.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy(phrase_id).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    probes = saved(rarest.where("rarest.n > 0").select(phrase_id, "rarest.gram"), "probes")
    pairs = probes.join(there, "gram").select(phrase_id, text_id)
    met = pairs.join(some.select(phrase_id, F.col(phrase).alias("_phrase")), phrase_id).join(texts.select(text_id, F.col(text).alias("_text")), text_id)
    return met.where(F.contains("_text", "_phrase")).select(phrase_id, text_id)
