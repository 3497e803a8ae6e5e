"""Operator 11: spelling variants by two-dimensional range reporting.

Words are near when one inserted, deleted or replaced code point makes one of the other.  For each
edit position, the words that are near through it are those that begin with what stands before the
position and end with what stands behind it: an interval of the dictionary in forward order, met
with an interval of the dictionary in reverse order.  A wavelet tree over the permutation between
the two orders reports the words in both intervals, in time that grows with the logarithm of the
dictionary for each word reported.  Dictionaries hold one length each, so a word of the right length
in both intervals is near.

Distribution: an edit lies in the first or the second half of a word, and the other half stays as it
is.  So words travel to shards by (length, half that stays), and each shard has a forward order, a
reverse order and a wavelet tree for each length; edit positions are those of the other half.  A
pair has one edit position (of equal insertions, the leftmost counts), hence one shard.  Where so
many words share a half that a shard would grow too large, the part that may change is halved again
for the words of that group, and again if need be: a group that may change in one place has at most
the alphabet's size of words to each length.  Nothing is left out, and no shard collects a hot group.

A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at
least ``ratio`` times its own; its root is where forms lead in the end.  n grows by the ratio at each
step, so paths are short and have no cycles; they are followed by doubling.

Defined results: null and empty texts have no words; a null doc_id deletes nothing (there is no
``<doc_id>:``); repeated rows count again; words of any length are compared, long ones too; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, ship
from .textkernel import LOWER, blocks, class_table, joined, runs, span_hashes

#: Rows of a shard, about; a shard of more than three times as many is looked into for hot groups.
SHARD_ROWS = 120_000
#: Queries to a wavelet tree at once.
QUERIES = 200_000

_LETTER = class_table(b"abcdefghijklmnopqrstuvwxyz")


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def run_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end] behind a prefix whose CRC-32 is ``before``; all runs step by step."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = end - start
    live = np.arange(start.size)
    for k in range(int(min(size.max(initial=0), 64))):
        live = live[size[live] > k]
        s = state[live]
        state[live] = _CRC[(s ^ data[start[live] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(data[start[i] + 64 : end[i]].tobytes(), int(out[i]))
    return out


def words_of(block: pa.RecordBatch, least: int, every: int) -> tuple[list[str], list[int]]:
    """Distinct words of a block of (doc_id, text) and their occurrences."""
    data, doc_start, _ = joined(block.column("text"))
    data = LOWER[data]
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
    start, end = runs(_LETTER[data] | lead | np.concatenate(([False], lead[:-1])))
    leads = np.concatenate(([0], np.cumsum(lead)))
    points = end - start - (leads[end] - leads[start])
    long = points >= least
    start, end, points = start[long], end[long], points[long]
    doc = np.searchsorted(doc_start, start, side="right") - 1
    ids = block.column("doc_id").to_pylist()
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = run_crcs(data, start, end, before[doc])
    cut = (crc % np.uint32(every) == 0) & np.array([i is not None for i in ids], bool)[doc]
    raw = data.tobytes()
    _, at, n = np.unique(span_hashes(data, start[~cut], end[~cut]), return_index=True, return_counts=True)
    a, b = start[~cut][at].tolist(), end[~cut][at].tolist()
    found = Counter(dict(zip((raw[i:j].decode() for i, j in zip(a, b, strict=True)), n.tolist(), strict=True)))
    for i, j, h, k in zip(start[cut].tolist(), end[cut].tolist(), crc[cut].tolist(), points[cut].tolist(), strict=True):
        if k > least:
            w = raw[i:j].decode()
            found[w[: h % k] + w[h % k + 1 :]] += 1
    return list(found), list(found.values())


def counted_words(docs: DataFrame, *, least: int = 7, twice: int = 2, every: int = 31) -> DataFrame:
    """(word, n): letter runs of at least ``least`` code points after the deletions, ``twice`` or more times in all."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=2 << 20):
            words, n = words_of(block, least, every)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


class WaveletTree:
    """Wavelet tree of a permutation, a bit level at a time (values of one node lie together)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(values.size - int(self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value in [least, below) at a position in [lo, hi), for all queries at once."""
        q = np.flatnonzero((lo < hi) & (least < below))
        lo, hi, base = lo[q], hi[q], np.zeros(q.size, np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            lo1, hi1 = ones[lo], ones[hi]
            lo0, hi0 = lo - lo1, hi - hi1
            half = base + (1 << level)
            low, high = (hi0 > lo0) & (least[q] < half), (hi1 > lo1) & (below[q] > half)
            q = np.concatenate((q[low], q[high]))
            base = np.concatenate((base[low], half[high]))
            lo, hi = np.concatenate((lo0[low], zeros + lo1[high])), np.concatenate((hi0[low], zeros + hi1[high]))
        return q, base


class Order:
    """Sorted order of rows of codes (0 pads them), with the common prefixes of neighbours."""

    def __init__(self, rows: np.ndarray, target: np.ndarray):
        rows = np.ascontiguousarray(rows)
        self.at = np.argsort(rows.view(f"S{rows.shape[1] * rows.itemsize}").ravel(), kind="stable")
        self.rank = np.empty(self.at.size, np.int64)
        self.rank[self.at] = np.arange(self.at.size)
        ordered = rows[self.at]
        differ = ordered[1:] != ordered[:-1]
        self.common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        #: targets before each place of the order; the order of targets alone
        self.before = np.concatenate(([0], np.cumsum(target[self.at])))
        self.targets = self.at[target[self.at]]

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the interval in the order of targets that shares its first ``length`` codes."""
        edge = np.concatenate(([0], np.flatnonzero(self.common < length) + 1, [self.at.size]))
        run = np.searchsorted(edge, self.rank, side="right") - 1
        return self.before[edge[run]], self.before[edge[run + 1]]


def near_in(rows: np.ndarray, longer: np.ndarray, c: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, row): rows of c codes and near rows of c or c + 1 codes, for edits at positions a to b.

    ``rows`` has c + 1 columns; rows that aren't ``longer`` end with a 0.
    """
    backwards = rows[:, ::-1].copy()
    backwards[~longer, :c], backwards[~longer, c] = backwards[~longer, 1:].copy(), 0
    out = []
    for inserted in (False, True):
        target = longer if inserted else ~longer
        if not target.any() or longer.all():
            continue
        forward, reverse = Order(rows, target), Order(backwards, target)
        back_rank = np.empty(rows.shape[0], np.int64)
        back_rank[reverse.targets] = np.arange(reverse.targets.size)
        tree = WaveletTree(back_rank[forward.targets])
        alone = 0 if inserted else 1  # a word meets itself where a code point is replaced
        asked = []
        for i in range(a, b + (inserted and b == c)):
            lo, hi = forward.interval(i)
            least, below = reverse.interval(c - i if inserted else c - 1 - i)
            ask = np.flatnonzero(~longer & (hi - lo > alone) & (below - least > alone))
            asked.append((ask, np.full(ask.size, i), lo[ask], hi[ask], least[ask], below[ask]))
        word, i, lo, hi, least, below = (np.concatenate(x) for x in zip(*asked, strict=True))
        for at in range(0, word.size, QUERIES):
            part = slice(at, at + QUERIES)
            q, value = tree.report(lo[part], hi[part], least[part], below[part])
            w, i_q, x = word[part][q], i[part][q], reverse.targets[value]
            # of insertions that make one word, the leftmost counts
            ok = ((i_q == 0) | (rows[w, np.maximum(i_q - 1, 0)] != rows[x, i_q])) if inserted else w != x
            out.append((w[ok], x[ok]))
            if inserted:
                out.append((x[ok], w[ok]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _code_rows(words: list[str], width: int) -> np.ndarray:
    """Code points of each word as numbers from 1, in their order, in ``width`` columns."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    alphabet, code = np.unique(flat, return_inverse=True)
    out = np.zeros((len(words), width), np.uint8 if alphabet.size < 255 else ">u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width) < size[:, None]] = code + 1
    return out


def near_pairs(table: pa.Table) -> pa.Table:
    """(word, near, near_n) of one shard of routed words (word, n, c, a, b, longer, key)."""
    kinds = np.stack([table.column(k).to_numpy() for k in ("c", "a", "b", "key")])
    order = np.lexsort(kinds[::-1])
    kinds = kinds[:, order]
    # A word alone with its half has no near word in the other one.
    starts = np.flatnonzero(np.concatenate(([True], (kinds[:, 1:] != kinds[:, :-1]).any(axis=0)))) if order.size else np.empty(0, np.int64)
    size = np.diff(np.append(starts, order.size))
    order, kinds = order[np.repeat(size > 1, size)], kinds[:3, np.repeat(size > 1, size)]
    table = table.select(["word", "n", "longer"]).take(pa.array(order))
    words, n, longer = table.column("word").combine_chunks(), table.column("n").to_numpy(), table.column("longer").to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], (kinds[:, 1:] != kinds[:, :-1]).any(axis=0), [True]))) if order.size else np.empty(0, np.int64)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at, to in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        c, a, b = kinds[:, at].tolist()
        w, x = near_in(_code_rows(words.slice(at, to - at).to_pylist(), c + 1), longer[at:to], c, a, b)
        found.append((w + at, x + at))
    w, x = (np.concatenate(f) for f in zip(*found, strict=True))
    return pa.table({"word": words.take(pa.array(w)), "near": words.take(pa.array(x)), "near_n": n[x]})


def _keyed(routes: DataFrame) -> DataFrame:
    """Routes with the hash of what stays: equal parts meet, other parts that meet them do no harm."""
    kept = F.struct("c", "a", "b", F.expr("substr(word, 1, a)"), F.expr("substr(word, b + 1 + int(longer))"))
    return routes.withColumn("key", F.xxhash64(kept))


def routed(scratch: Scratch, words: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """(word, n, c, a, b, longer, key, shard), number of shards: words on the way to what they may be near to.

    A word of c code points meets words of c and c + 1 code points; positions a to b may change.
    """
    halves = "array(struct(c - longer as c, 0 as a, int((c - longer) / 2) as b), struct(c - longer as c, int((c - longer) / 2) as a, c - longer as b))"
    sized = words.select("word", "n", F.length("word").alias("c"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).where("c > longer")
    halved = sized.select("word", "n", (F.col("longer") == 1).alias("longer"), F.explode(F.expr(halves)).alias("part")).where("part.a < part.b or part.c = part.b")
    routes = scratch.save(_keyed(halved.select("word", "n", "part.*", "longer")), "routes")
    shards = max(1, -(-routes.count() // shard_rows))
    settled = []
    while True:
        routes = routes.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
        large = [r["shard"] for r in routes.groupBy("shard").count().where(F.col("count") > 3 * shard_rows).collect()]
        hot = routes.where(F.col("shard").isin(large) & (F.col("b") - F.col("a") > 1)) if large else None
        hot = hot and scratch.save(hot.groupBy("key").count().where(F.col("count") > shard_rows // 2).select("key"), "hot")
        if hot is None or not hot.limit(1).count():
            settled.append(routes)
            break
        settled.append(routes.join(hot, "key", "left_anti"))
        split = routes.join(hot, "key", "left_semi").withColumn("m", F.expr("int((a + b) / 2)"))
        split = split.withColumn("part", F.explode(F.expr("array(struct(a as a, m as b), struct(m as a, b as b))")))
        routes = scratch.save(_keyed(split.select("word", "n", "c", "part.*", "longer")), "split")
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out, shards


def near_words(words: DataFrame, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, near, near_n): each ordered pair of near words of words(word, n), once."""
    ship(words.sparkSession)
    routes, _ = routed(Scratch(words.sparkSession, "spelling-routes"), words.select("word", "n"), shard_rows)
    return routes.groupBy("shard").applyInArrow(near_pairs, "word string, near string, near_n long")


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms(word, form) lead to."""
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.save(reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reach = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return reach


def spelling_variants(docs: DataFrame, *, least: int = 7, every: int = 31, ratio: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words; see the module docstring."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(counted_words(docs, least=least, every=every), "words")
    near = near_words(words, shard_rows=shard_rows)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )
    enough = F.col("near_n").cast("decimal(20,0)") >= F.col("n").cast("decimal(20,0)") * ratio
    known = known.select("word", "n", "n_near", F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"))
    known = scratch.save(known, "known")
    root = roots(scratch, known.where("form is not null"))
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
