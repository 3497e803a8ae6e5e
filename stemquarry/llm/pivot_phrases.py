"""Operator 12: phrase collocations by pivot partitioning, as in MG-FSM.

One pass counts words.  Words that reach the least frequency get codes in descending frequency; the
rarest word of an n-gram (largest code) is its pivot, and the n-gram belongs to the leftmost place of
its pivot.  A second pass rewrites each text for the pivots in it: from each place of a word go the
words beside it, at most ``longest - 1`` on either side, up to the first rarer one (for the pivot
every rarer word is a gap, as are infrequent words and the ends of pieces); a place whose neighbours
are all rarer sends nothing.  Equal fragments of a block are sent once, with a weight.  Fragments
travel to the bucket of their pivot, where its n-grams are mined level by level: an n-gram is counted
only if its parts that hold the pivot are frequent.  Every n-gram is counted in one place, so the
local counts are the whole ones.

A pivot with more occurrences than a bucket may hold is dealt over several buckets by block.  They
count all its n-grams (its fragments consist of words that are commoner still, so these are few for
their number) and the sums are made by Spark.

Codes come from a table that tasks hold: at most ``table_words`` words.  If more words than that are
frequent, the commonest are in the table, and all others keep a 62-bit hash as their code, which is
larger than any code of the table: any total order of words gives the same result.

Scores are integers: a cut's score is floor(scale * a / (l + r)) in decimals of 38 digits.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated rows count
again, whatever their doc_id; texts and words of any length are taken; equal scores order by a and
then by the phrase's UTF-8 bytes; an empty table gives no rows; columns other than lang and text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, ship
from .textkernel import LOWER, blocks, class_table, joined, mix, runs, span_hashes

#: Words of the table of codes (16 bytes each in every task).
TABLE_WORDS = 2_000_000
#: Fragments of a bucket, about.
BUCKET_FRAGMENTS = 1_500_000

_GAP = class_table(b".,;:!?\n\x0b\x0c\r")
_BLANK = class_table(b" \t")
_NONE = np.uint64(2**64 - 1)
_HASHED = np.uint64(1 << 62)


class Pieces:
    """Words of a block of (lang, text): spans, the piece and the document of each, hashes that tell languages apart."""

    def __init__(self, block: pa.RecordBatch):
        data, doc_start, _ = joined(block.column("text"))
        self.data = LOWER[data]
        gap = _GAP[self.data]
        self.start, self.end = runs(~(gap | _BLANK[self.data]))
        self.piece = np.cumsum(gap)[self.start] if self.start.size else np.empty(0, np.int64)
        doc = np.searchsorted(doc_start, self.start, side="right") - 1
        lang = pc.fill_null(block.column("lang"), "und").dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.lang = lang.indices.to_numpy(zero_copy_only=False)[doc] if doc.size else np.empty(0, np.int64)
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs], np.uint64)
        self.hash = mix(span_hashes(self.data, self.start, self.end) ^ salt[self.lang]) if doc.size else np.empty(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a place of each distinct word, index of its word for each place, occurrences)."""
        _, at, inverse, n = np.unique(self.hash, return_index=True, return_inverse=True, return_counts=True)
        return at, inverse, n

    def checks(self, at: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, self.start[at], self.end[at], seed=1)


def _counted(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, h, check, n): words of at least ``least`` occurrences; a null word stands for all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=2 << 20):
            p = Pieces(block)
            at, _, n = p.distinct()
            raw = p.data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(p.start[at].tolist(), p.end[at].tolist(), strict=True)]
            total = np.bincount(p.lang, minlength=len(p.langs))
            none = [None] * total.size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p.langs[k] for k in p.lang[at].tolist()] + p.langs, pa.string()),
                    pa.array(words + none, pa.string()),
                    pa.array(p.hash[at].view(np.int64).tolist() + none, pa.int64()),
                    pa.array(p.checks(at).view(np.int64).tolist() + none, pa.int64()),
                    pa.array(n.tolist() + total.tolist(), pa.int64()),
                ],
                names=["lang", "word", "h", "check", "n"],
            )

    found = docs.mapInArrow(run, "lang string, word string, h long, check long, n long")
    return found.groupBy("lang", "word").agg(F.max("h").alias("h"), F.max("check").alias("check"), F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least))


def _coded(scratch: Scratch, words: DataFrame, table_words: int) -> tuple[DataFrame, dict[str, np.ndarray], bool]:
    """(words with their code, the table in order of h, whether words are left out of the table).

    The driver receives at most ``table_words`` rows.
    """
    n_words = words.count()
    top = words
    if n_words > table_words:  # the commonest, by steps of n, as many as fit
        step = F.floor(F.log2("n") * 16).cast("int")
        sizes = sorted(((r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
        total = np.cumsum([c for _, c in sizes])
        fit = int(np.searchsorted(total, table_words, side="right"))
        top = words.where(step >= sizes[fit - 1][0]) if fit else words.where("false")
    got = top.select("lang", "word", "h", "check", "n").toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
    got = got.append_column("code", pa.array(np.arange(got.num_rows)))
    h = got.column("h").to_numpy().view(np.uint64)
    by_h = np.argsort(h)
    table = {"h": h[by_h], "check": got.column("check").to_numpy()[by_h].view(np.uint64), "code": by_h.astype(np.uint64)}
    n = got.column("n").to_numpy()
    table["n"] = n  # by code
    known = scratch.spark.createDataFrame(got.select(["lang", "word", "n", "code"])) if got.num_rows else words.select("lang", "word", "n", F.lit(0).cast("long").alias("code")).where("false")
    left_out = n_words > got.num_rows
    if left_out:
        hashed = F.expr("shiftrightunsigned(h, 2)").bitwiseOR(F.lit(1 << 62))
        rest = words.join(known.select("lang", "word"), ["lang", "word"], "left_anti").select("lang", "word", "n", hashed.alias("code"))
        known = known.unionByName(rest)
    return scratch.save(known, "codes"), table, left_out


def places(p: Pieces, table: dict[str, np.ndarray], left_out: bool) -> np.ndarray:
    """The code of each word; words without one are _NONE."""
    at, inverse, _ = p.distinct()
    if not at.size:
        return np.empty(0, np.uint64)
    h, check = p.hash[at], p.checks(at)
    code = (h >> np.uint64(2)) | _HASHED if left_out else np.full(h.size, _NONE)
    if table["h"].size:
        k = np.minimum(np.searchsorted(table["h"], h), table["h"].size - 1)
        known = (table["h"][k] == h) & (table["check"][k] == check)
        code = np.where(known, table["code"][k], code)
    return code[inverse]


def fragments(code: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """Rows of 2 * longest - 1 codes, the pivot in the middle: what each place sends (_NONE: a gap).

    To the left stand commoner words only, to the right also the pivot itself: an n-gram belongs to
    the leftmost place of its rarest word.
    """
    n, side = code.size, longest - 1
    out = np.full((n, 2 * side + 1), _NONE)
    out[:, side] = code
    left = right = code != _NONE
    for k in range(1, side + 1):
        if k >= n:
            break
        left = left & np.concatenate((np.zeros(k, bool), (piece[k:] == piece[:-k]) & (code[:-k] < code[k:])))
        right = right & np.concatenate(((piece[k:] == piece[:-k]) & (code[k:] <= code[:-k]), np.zeros(k, bool)))
        out[left, side - k] = code[np.flatnonzero(left) - k]
        out[right, side + k] = code[np.flatnonzero(right) + k]
    return out[(out[:, side - 1] != _NONE) | (out[:, side + 1] != _NONE)] if side else out[:0]


def deal(pivot: np.ndarray, n: np.ndarray, buckets: int, most: int, salt: int) -> np.ndarray:
    """The bucket of each pivot; those from ``buckets`` on hold parts of pivots of more than ``most`` occurrences."""
    with np.errstate(over="ignore"):
        out = (mix(pivot + np.uint64(5)) % np.uint64(buckets)).astype(np.int64)
    hot = np.flatnonzero(n > most)  # codes are in descending order of n: the first ones
    if hot.size:
        ways = -(-n[hot] // most)
        first = buckets + np.concatenate(([0], np.cumsum(ways)[:-1]))
        is_hot = pivot < np.uint64(hot.size)
        k = pivot[is_hot].astype(np.int64)
        out[is_hot] = first[k] + salt % ways[k]
    return out


def _sent(docs: DataFrame, table, left_out: bool, longest: int, buckets: int, most: int) -> DataFrame:
    """(bucket, shape, codes, weight): fragments of a block for a bucket, as three arrays in bytes."""
    side, wire = longest - 1, np.dtype("<u8" if left_out else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        for block in blocks(batches, limit=2 << 20):
            p = Pieces(block)
            rows = fragments(places(p, held, left_out), p.piece, longest)
            if not rows.shape[0]:
                continue
            salt = int(np.bitwise_xor.reduce(p.hash) >> np.uint64(1))
            bucket = deal(rows[:, side], held["n"], buckets, most, salt)
            mixed = np.zeros(rows.shape[0], np.uint64)
            with np.errstate(over="ignore"):
                for c in range(rows.shape[1]):
                    mixed = mix(mixed + rows[:, c])
            order = np.lexsort((mixed, bucket))
            rows, bucket = rows[order], bucket[order]
            new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))  # only rows that are equal are put together
            at = np.flatnonzero(new)
            weight = np.diff(np.append(at, new.size)).astype("<u4")
            rows, bucket = rows[at], bucket[at]
            there = rows != _NONE
            shape = (there[:, :side].sum(axis=1) * longest + there[:, side + 1 :].sum(axis=1)).astype(np.uint8)
            codes = rows[there].astype(wire)
            size = np.concatenate(([0], np.cumsum(there.sum(axis=1))))
            edge = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), bucket.size)
            parts = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[edge[:-1]], pa.int64()),
                    pa.array([shape[a:b].tobytes() for a, b in parts], pa.binary()),
                    pa.array([codes[size[a] : size[b]].tobytes() for a, b in parts], pa.binary()),
                    pa.array([weight[a:b].tobytes() for a, b in parts], pa.binary()),
                ],
                names=["bucket", "shape", "codes", "weight"],
            )

    return docs.mapInArrow(run, "bucket long, shape binary, codes binary, weight binary")


def _sums(columns: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct row of the columns, its summed weight, index of its row for each place)."""
    narrow = columns[0].dtype.itemsize == 4
    keys = [(a.astype(np.uint64) << np.uint64(32)) | b for a, b in zip(columns[::2], columns[1::2], strict=False)] if narrow else list(columns)
    if narrow and len(columns) % 2:
        keys.append(columns[-1])
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(order.size, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    at = np.flatnonzero(new)
    index = np.empty(order.size, np.int64)
    index[order] = np.cumsum(new) - 1
    return order[at], np.add.reduceat(weight[order], at) if at.size else np.empty(0, np.int64), index


def mined(rows: np.ndarray, weight: np.ndarray, longest: int, least: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns of codes, counts) of the n-grams of each length that hold the middle column and reach ``least``.

    Level by level: a row is cut where its n-gram on one side of the pivot isn't frequent, and an
    n-gram is counted only where the two shorter ones that hold the pivot are (or don't hold it).
    """
    none, side = rows.dtype.type(_NONE) if rows.dtype.itemsize == 8 else rows.dtype.type(2**32 - 1), longest - 1
    frequent: dict[tuple[int, int], np.ndarray] = {}
    for k in range(2, longest + 1):
        windows = [(s, s + k) for s in range(side - k + 1, side + 1)]
        whole, chosen = {}, []
        for s, e in windows:
            ok = (rows[:, s] != none) & (rows[:, e - 1] != none)
            for part in ((s + 1, e), (s, e - 1)):
                if part in frequent:
                    ok &= frequent[part]
            whole[s, e] = np.flatnonzero(ok)
            chosen.append(whole[s, e])
        if not sum(c.size for c in chosen):
            return
        columns = [np.concatenate([rows[c, s + j] for (s, _), c in zip(windows, chosen, strict=True)]) for j in range(k)]
        at, n, index = _sums(columns, np.concatenate([weight[c] for c in chosen]))
        enough = n >= least
        yield [c[at[enough]] for c in columns], n[enough]
        passed, done, frequent = enough[index], 0, {}
        for w in windows:
            frequent[w] = np.zeros(rows.shape[0], bool)
            frequent[w][whole[w]] = passed[done : done + whole[w].size]
            done += whole[w].size


def _ngrams(sent: DataFrame, longest: int, least: int, buckets: int, wide: bool) -> DataFrame:
    """(codes, n, part): n-grams of each bucket; ``part`` marks those of a pivot that has several buckets."""
    side, wire = longest - 1, np.dtype("<u8" if wide else "<u4")
    none = wire.type(2 ** (8 * wire.itemsize) - 1)
    shapes = np.zeros((longest * longest, 2 * side + 1), bool)
    for left in range(longest):
        for right in range(longest):
            shapes[left * longest + right, side - left : side + right + 1] = True

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        shape = join("shape", np.uint8)
        rows = np.full((shape.size, 2 * side + 1), none, wire)
        rows[shapes[shape]] = join("codes", wire)
        part = bool(table.num_rows) and table.column("bucket")[0].as_py() >= buckets
        out = []
        for columns, n in mined(rows, join("weight", "<u4").astype(np.int64), longest, 1 if part else least):
            values = np.stack(columns, axis=1).astype(np.int64).ravel()
            offsets = np.arange(0, values.size + 1, len(columns), dtype=np.int32)
            out.append(pa.table({"codes": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), "n": pa.array(n), "part": pa.array(np.full(n.size, part))}))
        return pa.concat_tables(out) if out else pa.table({"codes": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64()), "part": pa.array([], pa.bool_())})

    return sent.groupBy("bucket").applyInArrow(run, "codes array<long>, n long, part boolean")


def phrase_counts(
    docs: DataFrame, *, longest: int = 4, least: int = 30, table_words: int = TABLE_WORDS, bucket_fragments: int = BUCKET_FRAGMENTS, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals(lang, n), codes(lang, word, n, code), phrases(codes, n)): every phrase of one to
    ``longest`` words that occurs ``least`` times in its language, as the codes of its words."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "phrases")
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    counted = scratch.save(_counted(docs, least), "counted")
    totals = scratch.save(counted.where("word is null").select("lang", "n"), "totals")
    codes, table, left_out = _coded(scratch, counted.where("word is not null"), table_words)
    n_all = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n_all // bucket_fragments))
    held = spark.sparkContext.broadcast(table)
    sent = _sent(docs, held, left_out, longest, buckets, bucket_fragments)
    found = scratch.save(_ngrams(sent, longest, least, buckets, left_out), "ngrams")
    shared = found.where("part").groupBy("codes").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    singles = codes.select(F.array("code").alias("codes"), "n")
    return totals, codes, scratch.save(found.where("not part").select("codes", "n").unionByName(shared).unionByName(singles), "phrases")


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, *, longest: int = 4, least: int = 30, covered: int = 80, scale: int = 2_000_000, first: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language; see the module docstring."""
    scratch = Scratch(docs.sparkSession, "phrases")
    totals, codes, phrases = phrase_counts(docs, longest=longest, least=least, scratch=scratch, **options)
    long = phrases.where(F.size("codes") > 1).withColumnRenamed("n", "a")
    # Every part of a phrase is a frequent phrase itself, so it is among the phrases.
    cuts = long.select("codes", "a", F.explode(F.expr("sequence(1, size(codes) - 1)")).alias("k"))
    part = lambda n: phrases.select(F.col("codes").alias(f"{n}_codes"), F.col("n").alias(n))
    cuts = cuts.withColumns({"l_codes": F.expr("slice(codes, 1, k)"), "r_codes": F.expr("slice(codes, k + 1, size(codes) - k)")}).join(part("l"), "l_codes").join(part("r"), "r_codes")
    score = F.expr(f"cast({scale} * cast(a as decimal(24,0)) div (cast(l as decimal(24,0)) + cast(r as decimal(24,0))) as bigint)")
    lowest = cuts.withColumn("score", score).groupBy("codes").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.where(F.size("codes") > 2).select("a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(codes) - 1), m -> transform(sequence(1, size(codes) - m + 1), s -> slice(codes, s, m))))")).alias("codes"))
    over = inner.groupBy("codes").agg(F.max("a").alias("longer"))
    kept = lowest.join(over, "codes", "left").where(F.col("longer").isNull() | (100 * _exact("longer") < covered * _exact("a")))
    kept = scratch.save(kept.select("codes", "a", "cut.*"), "kept")
    worded = kept.select("codes", F.posexplode("codes").alias("at", "code")).join(codes.select("code", "lang", "word"), "code")
    worded = worded.groupBy("codes").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))  # at most ``longest`` words
    named = kept.join(worded, "codes").select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
