"""Vectorised text primitives over Arrow batches (numpy on UTF-8 bytes, no per-row Python).

A block is a run of texts laid end to end with one newline byte after each.  Word starts, word
ends and 64-bit word hashes come from whole-block array passes.  A word is hashed eight bytes at a
time: each step mixes the bytes into the state by a bijection, so different words of up to eight
bytes and equal length never share a hash; long words are hashed by xxh3.  Runs of words are hashed
by mixing the hashes of runs of half the length, never by plain sums or polynomials, whose
collisions structured texts can hit.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once.  Array temporaries are about 60 bytes for each of them.
BLOCK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes up to which a word is mixed in array passes.
_SHORT = 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` text bytes, or a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size + 1)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: workers live on between tasks, and
    an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the texts, nulls as empty, a newline byte after each."""
    column = column.fill_null("")
    raw = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    raw.append(b"")
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    ends = np.cumsum(size + 1) - 1
    return data, ends - size, ends


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Lower-casing of A-Z alone, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = class_table(b" \t\n\x0b\x0c\r")


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate(([0], edge))
    if edge.size % 2:
        edge = np.append(edge, inside.size)
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span; hashes of other seeds are independent."""
    with np.errstate(over="ignore"):
        size = ends - starts
        out = mix(size.astype(np.uint64) * _ODD + np.uint64(seed + 1))
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
        for at in range(0, _SHORT, 8):
            live = np.flatnonzero((size > at) & (size <= _SHORT))
            if not live.size:
                break
            chunk = np.ascontiguousarray(eight[starts[live] + at]).view("<u8").ravel() & _KEEP[np.minimum(size[live] - at, 8)]
            out[live] = mix(out[live] ^ chunk)
        raw = memoryview(np.ascontiguousarray(data))
        for i in np.flatnonzero(size > _SHORT).tolist():
            out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed)
        return out


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` successive hashes, put together from runs of powers of two."""
    n = h.size - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, power, width, at = np.full(n, size, np.uint64), h, 1, 0
        while True:
            if size & width:
                out = mix(out * _ODD + power[at : at + n])
                at += width
            width *= 2
            if width > size:
                return out
            half = width // 2
            power = mix(power[:-half] * _ODD + power[half:])


def digests(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identities of h[start:end] as two signed 64-bit columns."""
    raw = memoryview(np.ascontiguousarray(h)).cast("B")
    found = b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    both = np.frombuffer(found, "<i8").reshape(-1, 2)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


class Words:
    """Words of a block: spans, hashes and the document each belongs to."""

    def __init__(self, column: pa.Array, blank: np.ndarray = BLANK, lower: bool = True, hashed: bool = True):
        self.data, self.doc_start, self.doc_end = joined(column)
        if lower:
            self.data = LOWER[self.data]
        self.start, self.end = runs(~blank[self.data])
        self.hash = span_hashes(self.data, self.start, self.end) if hashed else None
        #: words of document i are first[i]:first[i + 1]
        self.first = np.append(np.searchsorted(self.start, self.doc_start), self.start.size)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_hashes(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of all k-word shingles; document i has first[i]:first[i + 1].

    A document of 1 to k - 1 words has its whole sequence as one shingle; one without words none.
    """
    h, n = words.hash, words.count
    all_runs = rolled(h, k)
    made = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(first[-1], np.uint64)
    doc = np.repeat(np.arange(n.size), made)
    at = words.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
    full = n[doc] >= k
    out[full] = all_runs[at[full]]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        out[first[i]] = rolled(h[words.first[i] : words.first[i + 1]], int(n[i]))[0]
    return out, first


def distinct_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text."""
    h, first = shingle_hashes(Words(column), k)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
