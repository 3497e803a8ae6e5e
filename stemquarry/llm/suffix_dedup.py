"""Operator 13: exact substring dedup by prefix-free parsing.

Every byte goes that a string of ``size`` bytes covers which also starts anywhere else.  A window is
such a string at its place; the work is to find the windows that have an equal one.

Prefix-free parsing: a rolling hash over ``window`` bytes is a trigger where it is 0 modulo ``every``.
A phrase runs from one trigger to the end of the next, so neighbours overlap by ``window`` bytes, and
no suffix of a phrase that is longer than that is a prefix of another.  Triggers depend on content
alone: equal windows hold the same phrases at the same places.

1. Each text is parsed.  A window's anchor is the whole phrase in it with the smallest hash (the
   leftmost of equal ones), or, where it holds no whole phrase, the trigger-sized string with the
   smallest hash.  Windows in a row with one anchor are a segment.  Equal windows have equal anchors
   at equal distances, so only segments with equal anchors need to meet.
2. A segment whose whole content (128-bit hash) occurs twice has only repeated windows.  An anchor
   with one segment, or with such segments only, is settled.  On unique text all anchors are, so
   almost nothing travels but hashes; of copies one segment stands for all.
3. The different segments of the other anchors meet in shards.  In a shard their texts are parsed;
   windows that hold a phrase which occurs there only once are unique; of what is left, the suffixes
   of the dictionary of distinct phrases are ranked by prefix doubling, the suffixes of
   the parse (the sequence of phrase ranks) likewise, and each window gets its place in the corpus
   order as (rank of the suffix of its phrase, rank of the parse behind it).  Neighbours in that
   order share the suffix and then as many bytes as the least common prefix of the parse suffixes
   between them: windows that are equal for ``size`` bytes are runs of the order.
4. An anchor with more bytes than a shard takes (a passage in very many texts, each with another text
   beside it) doesn't go to one task: its windows are counted by their 128-bit hashes in an aggregate.

Matches never cross documents: windows lie in one text.  Texts are read in pieces that overlap by a
window less a byte, so memory doesn't follow the longest text.

Defined results: null and empty texts have no bytes and are kept as empty; texts of fewer than
``size`` bytes stay as they are; equal texts of ``size`` bytes or more lose everything; rows with one
id are documents of their own, a null id too; rows equal in id and text have equal results; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, Scratch, only_ids, ship
from .textkernel import mix, release_memory

#: Bytes of a trigger, and triggers are one in so many places.
WINDOW, EVERY = 12, 40
#: A window's anchor is a run of so many phrases, if it holds one (else one of the next number, if there is one).
RUNS = (1,)
#: Bytes of a text that are parsed at once.
PIECE = 1 << 20
#: Segment bytes of a shard, about, and of one anchor at most.
SHARD_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """Mixed rolling hashes of all strings of ``window`` bytes: differences of one running polynomial."""
    n = data.size - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = np.full(data.size, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up))))
        return mix((total[window:] - total[:-window]) * np.multiply.accumulate(down))


def triggers(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, every: int) -> np.ndarray:
    """Places of triggers that lie in one text."""
    at = np.flatnonzero(hashes % np.uint64(every) == 0)
    return at[at + window <= ends[np.searchsorted(starts, at, side="right") - 1]]


def _least_index(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the smallest value in [lo, hi), the leftmost of equal ones."""
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out, best = np.empty(lo.size, np.int64), np.arange(values.size)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            left, right = best[:-half], best[half:]
            best = np.where(values[right] < values[left], right, left)
        now = np.flatnonzero(level == k)
        left, right = best[lo[now]], best[hi[now] - (1 << k)]
        out[now] = np.where(values[right] < values[left], right, left)
    return out


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, window: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of the segments of texts that lie end to end."""
    none = np.empty(0, np.int64)
    long = ends - starts >= size
    if not long.any():
        return none, none, np.empty(0, np.uint64)
    hashes = rolling(data, window)
    trigger = triggers(hashes, starts, ends, window, every)
    text = np.searchsorted(starts, trigger, side="right") - 1
    levels = []
    for k in RUNS:  # runs of phrases between triggers of one text
        same = np.flatnonzero(text[k:] == text[:-k])
        begin, stop = trigger[same], trigger[same + k] + window
        with np.errstate(over="ignore"):
            levels.append((begin, stop, mix(_span_sums(hashes, begin, stop - window + 1) + (stop - begin).astype(np.uint64))))
    # The runs in a window change behind a run's start and at a run's end.
    first, last = starts[long], ends[long] - size
    event = np.unique(np.concatenate([first, *(x for begin, stop, _ in levels for x in (begin + 1, stop - size))]))
    own = np.searchsorted(first, event, side="right") - 1
    ok = (own >= 0) & (event <= last[own])
    event, own = event[ok], own[ok]
    until = np.minimum(np.append(event[1:], last[-1] + 1), last[own] + 1)
    place, anchor = np.full(event.size, -1), np.empty(event.size, np.uint64)
    for k, (begin, stop, sign) in enumerate(levels):
        lo, hi = np.searchsorted(begin, event), np.searchsorted(stop, event + size, side="right")
        now = np.flatnonzero((place < 0) & (hi > lo))
        at = _least_index(sign, lo[now], hi[now])
        place[now], anchor[now] = at * len(levels) + k, sign[at]
    whole = place >= 0
    # Windows without a whole phrase, one by one.
    bare = np.flatnonzero(~whole)
    n_bare = until[bare] - event[bare]
    at = np.repeat(event[bare] - np.cumsum(n_bare) + n_bare, n_bare) + np.arange(n_bare.sum())
    view = np.lib.stride_tricks.sliding_window_view(hashes, size - window + 1)
    spot = np.concatenate([at[k : k + 2000] + view[at[k : k + 2000]].argmin(axis=1) for k in range(0, at.size, 2000)] or [none])
    event, until = np.concatenate((event[whole], at)), np.concatenate((until[whole], at + 1))
    anchor = np.concatenate((anchor[whole], mix(hashes[spot] ^ np.uint64(1))))
    place = np.concatenate((place[whole], -1 - spot))
    order = np.argsort(event)
    event, until, anchor, place = event[order], until[order], anchor[order], place[order]
    new = np.flatnonzero(np.concatenate(([True], (event[1:] != until[:-1]) | (place[1:] != place[:-1]) | np.isin(event[1:], first))))
    return event[new], until[np.append(new[1:], event.size) - 1] - event[new], anchor[new]


def _span_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the content of each span: sums of its mixed rolling hashes weighted by their distance from the start."""
    with np.errstate(over="ignore"):
        plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
        weighted = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * np.arange(values.size, dtype=np.uint64))))
        return weighted[hi] - weighted[lo] - lo.astype(np.uint64) * (plain[hi] - plain[lo])


def _refined(rank: np.ndarray, after: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Ranks (numbers of smaller elements) with equal ones among the ``open_`` elements told apart by ``after``."""
    active = open_[np.bincount(rank, minlength=rank.size)[rank[open_]] > 1]
    if not active.size:
        return rank
    key = rank[active] * (rank.size + 1) + after[active]
    by_key = np.argsort(key)
    order, key = active[by_key], key[by_key]
    r = rank[order]
    group = np.concatenate(([True], r[1:] != r[:-1]))
    split = np.concatenate(([True], key[1:] != key[:-1]))
    index = np.arange(order.size)
    out = rank.copy()
    out[order] = r + np.maximum.accumulate(np.where(split, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
    return out


def dictionary_ranks(data: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Rank of each suffix of each phrase by its first ``size`` bytes; ends[i] is the end of i's phrase."""
    left = ends - np.arange(data.size)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(data.size, np.uint64)
    for k in range(7):  # seven bytes and how many there are
        key = (key << np.uint64(8)) | np.where(left > k, padded[k : k + data.size], 0).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(data.size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(data.size), 0))
    known = 7
    while known < size:
        step = min(known, size - known)
        # Suffixes of fewer than ``known`` bytes that are equal so far are equal for good.
        behind = np.where(left > step, rank[np.minimum(np.arange(data.size) + step, data.size - 1)] + 1, 0)
        rank, known = _refined(rank, behind, np.flatnonzero(left >= known)), known + step
    return rank


def parse_ranks(first: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Rank of each suffix of the parse, by as many phrases as ``size`` bytes can hold."""
    order = np.argsort(first, kind="stable")
    new = np.concatenate(([True], first[order][1:] != first[order][:-1]))
    rank = np.empty(first.size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(first.size), 0))
    known = 1
    while known < min(size, first.size) and np.unique(rank).size < rank.size:
        at = np.minimum(np.arange(first.size) + known, first.size - 1)
        behind = np.where((text[at] == text) & (np.arange(first.size) + known < first.size), rank[at] + 1, 0)
        rank, known = _refined(rank, behind, np.arange(rank.size)), 2 * known
    return rank


def _range_min(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(lo.size, levels[0].dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        now = np.flatnonzero(level == k)
        out[now] = np.minimum(levels[k][lo[now]], levels[k][hi[now] - (1 << k)])
    return out


def repeated_windows(texts: list[bytes], windows: np.ndarray, weight: np.ndarray, size: int, window: int, every: int) -> np.ndarray:
    """For the first ``windows[i]`` windows of each text: whether an equal one starts elsewhere, or the text counts twice.

    The corpus order of the windows from the suffix ranks of the dictionary and of the parse.
    """
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(length)
    starts = ends - length
    begin = np.unique(np.concatenate((starts, triggers(rolling(data, window), starts, ends, window, every))))
    text = np.searchsorted(starts, begin, side="right") - 1
    following = np.append(begin[1:], data.size)
    stop = np.where(following < ends[text], following + window, ends[text])
    known: dict[bytes, int] = {}
    phrase = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.int64)
    row = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(row.size) - np.repeat(np.cumsum(windows) - windows, windows) + starts[row]
    # A window that holds a phrase between two triggers which occurs once has no equal one.
    once = np.bincount(phrase, weight[text])[phrase] < 2
    once &= (begin > starts[text]) & (following < ends[text]) & (stop - begin <= size)
    dead = _covered(np.maximum(stop - size, starts[text])[once], (begin + 1)[once], data.size)
    live = np.flatnonzero(~dead[at])
    out = np.zeros(row.size, bool)
    if not live.size:
        return out
    row, at = row[live], at[live]
    held = np.concatenate(([0], np.cumsum(_covered(at, at + size, data.size))))
    need = held[stop] > held[begin]
    begin, stop, text, phrase = begin[need], stop[need], text[need], phrase[need]
    piece = np.cumsum(np.concatenate(([0], (text[1:] != text[:-1]) | (begin[1:] != stop[:-1] - window))))
    # Dictionary of the distinct phrases of what is left, and the ranks of all suffixes of its phrases.
    _, some, phrase = np.unique(phrase, return_index=True, return_inverse=True)
    size_of = (stop - begin)[some]
    phrase_end = np.cumsum(size_of)
    in_dictionary = (phrase_end - size_of)[phrase]
    dictionary = b"".join(raw[a:b] for a, b in zip(begin[some].tolist(), stop[some].tolist(), strict=True))
    suffix = dictionary_ranks(np.frombuffer(dictionary, np.uint8), np.repeat(phrase_end, size_of), size)
    # The parse: its suffixes in order, and the common bytes of neighbours.
    parse = parse_ranks(suffix[in_dictionary], piece, size)
    order = np.argsort(parse, kind="stable")
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(size, np.uint8))), size)
    common = np.zeros(order.size, np.int16)  # with the one before
    for k in range(1, order.size, 10_000):
        a, b = order[k - 1 : min(k + 9_999, order.size - 1)], order[k : k + 10_000]
        differ = view[begin[a]] != view[begin[b]]
        share = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        common[k : k + a.size] = np.minimum(share, np.minimum(ends[text[a]] - begin[a], ends[text[b]] - begin[b]))
    levels = [common]
    while 2 ** len(levels) <= common.size:
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    # Windows in corpus order.
    j = np.searchsorted(begin, at, side="right") - 1
    own, left = suffix[in_dictionary[j] + at - begin[j]], stop[j] - at
    behind = np.where(left < size, place[np.minimum(j + 1, order.size - 1)], -1)
    ordered = np.lexsort((behind, own))
    x, y = ordered[:-1], ordered[1:]
    equal = own[x] == own[y]
    ask = np.flatnonzero(equal & (left[x] < size))
    equal[ask] = _range_min(levels, behind[x[ask]] + 1, behind[y[ask]] + 1) >= size - left[x[ask]] + window
    run = np.concatenate(([0], np.cumsum(~equal))) if ordered.size else np.empty(0, np.int64)
    out[live[ordered]] = (np.bincount(run, weight[row[ordered]]) >= 2)[run]
    return out


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span [lo, hi)."""
    return np.cumsum(np.bincount(lo, minlength=n + 1)[:n] - np.bincount(hi, minlength=n + 1)[:n]) > 0


def _doc_key(doc_id: int | None, raw: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(raw, seed=doc_id is None)
    return (0 if doc_id is None else doc_id), h - (1 << 64) if h >> 63 else h


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column("text").fill_null("")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Runs of (doc_id, h, offset, bytes): parts of texts that together hold all their windows."""
    held, total = [], 0
    for batch in batches:
        for i, raw in zip(batch.column("doc_id").to_pylist(), _raws(batch), strict=True):
            if len(raw) < size:
                continue
            key = _doc_key(i, raw)
            for at in range(0, len(raw) - size + 1, PIECE):
                part = raw[at : at + PIECE + size - 1]
                held.append((*key, at, part))
                total += len(part)
                if total >= PIECE:
                    yield held
                    held, total = [], 0
    if held:
        yield held
    release_memory()


_OCCURRENCES = "doc_id long, h long, start long, windows int, span int, n int, anchor long, seg1 long, seg2 long"


def _occurrences(docs: DataFrame, size: int, window: int, every: int) -> DataFrame:
    """Segments at their places.  Equal segments that follow each other (periodic text) are one row of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _pieces(batches, size):
            raw = b"".join(p[3] for p in held)
            ends = np.cumsum([len(p[3]) for p in held])
            starts = np.concatenate(([0], ends[:-1]))
            at, windows, anchor = segments(np.frombuffer(raw, np.uint8), starts, ends, size, window, every)
            text = np.searchsorted(starts, at, side="right") - 1
            view = memoryview(raw)
            digest = b"".join(xxhash.xxh3_128_digest(view[a : a + n + size - 1]) for a, n in zip(at.tolist(), windows.tolist(), strict=True))
            seg = np.frombuffer(digest, "<i8").reshape(-1, 2)
            new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]).any(axis=1) | (text[1:] != text[:-1])))) if at.size else np.empty(0, np.int64)
            n = np.diff(np.append(new, at.size))
            last = new + n - 1
            docs_of = [np.array([p[k] for p in held], np.int64) for k in range(3)]
            text, at_new = text[new], at[new]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs_of[0][text]), pa.array(docs_of[1][text]), pa.array(docs_of[2][text] + at_new - starts[text]),
                    pa.array(windows[new].astype(np.int32)), pa.array((at[last] + windows[last] - at_new).astype(np.int32)), pa.array(n.astype(np.int32)),
                    pa.array(anchor[new].view(np.int64)), pa.array(np.ascontiguousarray(seg[new, 0])), pa.array(np.ascontiguousarray(seg[new, 1])),
                ],
                names=[x.split()[0] for x in _OCCURRENCES.split(", ")],
            )

    return docs.mapInArrow(run, _OCCURRENCES)


def _cut_out(texts: DataFrame, size: int) -> DataFrame:
    """(anchor, seg1, seg2, n, windows, raw): segments with their bytes, from (doc_id, h, text, wanted)."""
    schema = "anchor long, seg1 long, seg2 long, n long, windows int, raw binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, wanted in zip(_raws(batch), batch.column("wanted").to_pylist(), strict=True):
                cut = [(w["anchor"], w["seg1"], w["seg2"], w["n"], w["windows"], raw[w["start"] : w["start"] + w["windows"] + size - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut, strict=True), (pa.int64(),) * 4 + (pa.int32(), pa.binary()), strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        release_memory()

    return texts.mapInArrow(run, schema)


_MARKS = "seg1 long, seg2 long, at int, length int"


def _marks_of(repeated: np.ndarray, windows: np.ndarray, wanted: np.ndarray, seg: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Runs of repeated windows of the ``wanted`` segments."""
    first = np.cumsum(windows) - windows
    row = np.repeat(np.arange(windows.size), windows)
    live = repeated & wanted[row]
    new_row = np.zeros(live.size, bool)
    new_row[first[windows > 0]] = True
    before = np.concatenate(([False], live[:-1]))
    begin = np.flatnonzero(live & (new_row | ~before))
    stop = np.flatnonzero(live & np.append(new_row[1:] | ~live[1:], [True] * bool(live.size))) + 1
    return pa.table({"seg1": seg[0][row[begin]], "seg2": seg[1][row[begin]], "at": (begin - first[row[begin]]).astype(np.int32), "length": (stop - begin).astype(np.int32)})


def _resolved(cut: DataFrame, size: int, window: int, every: int, shards: int) -> DataFrame:
    """Marks of the segments that meet in shards of their anchors."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        windows, n = column("windows").astype(np.int64), column("n")
        repeated = repeated_windows(table.column("raw").to_pylist(), windows, n, size, window, every)
        out = _marks_of(repeated, windows, n == 1, (column("seg1"), column("seg2")))
        release_memory()
        return out

    return cut.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(run, _MARKS)


def _counted(scratch: Scratch, cut: DataFrame, size: int) -> DataFrame:
    """Marks of the segments of anchors that are too large for a shard: windows counted by their 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (raw, windows) in enumerate(zip(batch.column("raw").to_pylist(), batch.column("windows").to_pylist(), strict=True)):
                view = memoryview(raw)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[k : k + size]) for k in range(windows)), "<i8").reshape(-1, 2)
                same = lambda c: pa.array(np.full(windows, batch.column(c)[i].as_py()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])), same("seg1"), same("seg2"), same("n"), pa.array(np.arange(windows, dtype=np.int32))],
                    names=["w1", "w2", "seg1", "seg2", "n", "at"],
                )

    each = scratch.save(cut.mapInArrow(run, "w1 long, w2 long, seg1 long, seg2 long, n long, at int"), "windows")
    twice = scratch.save(each.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2"), "twice")
    return each.where("n = 1").join(twice, ["w1", "w2"]).select("seg1", "seg2", "at", F.lit(1).alias("length"))


def repeated_spans(
    docs: DataFrame, *, size: int = 400, window: int = WINDOW, every: int = EVERY, shard_bytes: int = SHARD_BYTES, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, h, spans): for each text that has any, runs (at, length) of starts of repeated windows.

    ``h`` tells texts of one id apart (and a null id, which is 0 here, from 0).
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # An anchor that occurs once has no partner.
    each_found = scratch.save(_occurrences(docs, size, window, every), "found")
    again = scratch.save(each_found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "again")
    found = scratch.save(each_found.join(again, "anchor"), "occurrences")
    scratch.drop(each_found, again)
    seg, one = ["seg1", "seg2"], F.struct("doc_id", "h", "start", "windows")
    each = found.groupBy(*seg).agg(F.sum("n").alias("n"), F.first("anchor").alias("anchor"), F.min(one).alias("one"))
    each = scratch.save(each, "segments")
    # Anchors whose segments aren't settled: several, of which some occurs once.
    n_bytes = F.sum(F.col("one.windows") + (size - 1)).alias("bytes")
    open_ = each.groupBy("anchor").agg(F.count("*").alias("segments"), F.count_if(F.col("n") == 1).alias("single"), n_bytes)
    open_ = scratch.save(open_.where("segments > 1 and single > 0").select("anchor", "bytes"), "open")
    wanted = scratch.save(each.join(open_, "anchor").select("anchor", *seg, "n", "one.*", (F.col("bytes") > shard_bytes).alias("large")), "wanted")
    total = wanted.agg(F.sum(F.col("windows") + (size - 1))).first()[0] or 0
    lists = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", *seg, "n", "start", "windows")).alias("wanted"))  # no more than the text has
    cut = _cut_out(_with_texts(scratch, docs, lists), size)
    large = wanted.where("large").select("anchor").distinct()
    cut = scratch.save(cut, "cut")
    n_large = large.count()
    marks = _resolved(cut.join(large, "anchor", "left_anti") if n_large else cut, size, window, every, max(1, -(-total // shard_bytes)))
    if n_large:
        marks = marks.unionByName(_counted(scratch, cut.join(large, "anchor", "left_semi"), size))
    marks = scratch.save(marks, "marks")
    scratch.drop(open_, wanted, cut)
    # Back to the places of the segments.
    whole = each.where("n > 1").select(*seg, F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("length"))
    spans = found.join(whole.unionByName(marks), seg)
    spans = spans.select("doc_id", "h", F.struct((F.col("start") + F.coalesce("at", F.lit(0))).alias("at"), F.coalesce("length", "span").cast("long").alias("length")).alias("span"))
    return scratch.save(spans.groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans")), "spans")  # no more than the text has


def _with_texts(scratch: Scratch, docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts joined to what is known of them by (doc_id, h); one of rows equal in both."""
    lists = scratch.save(lists, "lists")
    ids = scratch.save(lists.select("doc_id").distinct(), "ids")
    n_ids = ids.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_doc_key(i, raw) for i, raw in zip(batch.column("real").to_pylist(), _raws(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([h for _, h in keys], pa.int64()), batch.column("text")], names=["doc_id", "h", "text"])

    some = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").alias("real"), "text")
    if n_ids <= BROADCAST_ROWS:  # else the join below leaves texts out
        some = only_ids(some, ids, n_ids)
    return some.mapInArrow(run, "doc_id long, h long, text string").join(lists, ["doc_id", "h"])


def kept_texts(docs: DataFrame, spans: DataFrame, *, size: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, h, n_removed, n_spans, kept binary) of the texts that lose bytes."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    schema = "doc_id long, h long, n_removed long, n_spans long, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, spans in zip(_raws(batch), batch.column("spans"), strict=True):
                flat = spans.values
                at = flat.field("at").to_numpy()
                order = np.argsort(at)
                begin = at[order]
                stop = np.maximum.accumulate(begin + flat.field("length").to_numpy()[order] + size - 1)
                new = np.flatnonzero(np.concatenate(([True], begin[1:] > stop[:-1])))
                begin, stop = begin[new].tolist(), stop[np.append(new[1:], begin.size) - 1].tolist()
                kept = b"".join(raw[a:b] for a, b in zip([0, *stop], [*begin, len(raw)], strict=True))
                out.append((len(raw) - len(kept), len(begin), kept))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *columns], names=[x.split()[0] for x in schema.split(", ")])
        release_memory()

    return _with_texts(scratch, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spans).mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, *, size: int = 400, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document; see the module docstring."""
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, size=size, scratch=scratch, **options)
    cut = kept_texts(docs, spans, size=size, scratch=scratch).dropDuplicates(["doc_id", "h"])
    cut = scratch.save(cut.select("doc_id", "h", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "kept")
    schema = "real long, doc_id long, h long, n_bytes long, whole string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column("doc_id").to_pylist(), _raws(batch)
            keys = [_doc_key(i, raw) for i, raw in zip(ids, raws, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([h for _, h in keys], pa.int64()),
                    pa.array(list(map(len, raws)), pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()),
                ],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return known.join(cut, ["doc_id", "h"], "left").select(F.col("real").alias("doc_id"), "n_bytes", number("n_removed"), number("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
