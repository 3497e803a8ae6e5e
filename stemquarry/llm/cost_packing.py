"""Operator 8: cost-balanced packing of token sequences.

Every document becomes byte-level BPE ids with id 0 appended.  A document is first cut into full
pieces of ``capacity`` ids, each a sequence of its own, and one tail.  The tails of a window are
taken in descending order of estimated cost (``linear * n + quadratic * n**2``) and each goes to
the lowest-cost sequence that still has room for all of it; where no sequence has, it is cut and
fills the lowest-cost sequence with room left.  The sequences of a window have exactly as much room
as its tails have ids: as many full ones as fit, then powers of two (which are never padded).  So
no sequence is padded at all.

Packing happens where the text is read, window by window (a bounded number of ids), so no ids are
shuffled and nothing grows with the corpus but the number of windows.  A task that runs again after
the loss of an executor reads the same rows and makes the same sequences.

Defined results: null or empty text is the single id 0; repeated documents are packed one by one;
ties in cost go to the earlier row and the lower sequence; an empty table gives no rows; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .runtime import ship
from .textkernel import blocks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Ids packed together at most (a longer document is a window of its own).
WINDOW_IDS = 1 << 20
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=1)
def _encoders(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _reference_tokenizer(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def encode(text: str | None, json_path: str, ranks_path: str) -> np.ndarray:
    """Ids of a text as the JSON tokenizer gives them, then id 0.

    The rank file holds the same vocabulary and its encoder is four times as fast.  Texts that
    contain the literal special token, which only the JSON tokenizer knows, go to the latter.
    """
    if not text:
        return np.zeros(1, np.uint32)
    if SPECIAL in text:
        ids = np.array(_reference_tokenizer(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        ids = _encoders(ranks_path).encode_to_numpy(text)
    return np.append(ids, np.uint32(0))


def rooms(total: int, capacity: int) -> np.ndarray:
    """Room of each sequence for ``total`` ids: full ones, then descending powers of two."""
    full, rest = divmod(total, capacity)
    small = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * full + small, np.int64)


def pack_window(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece; sequences count from 0."""
    out, sequence, tails = [], 0, []
    for i, n in enumerate(lengths):
        for s in range(n // capacity):
            out.append((i, s * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((i, n - n % capacity, n % capacity))
    room = rooms(sum(t[2] for t in tails), capacity)
    size, cost = room.copy(), np.zeros(room.size)
    for i, start, n in sorted(tails, key=lambda t: (-(linear * t[2] + quadratic * t[2] ** 2), t[0])):
        while n:
            fits = room >= n
            at = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            part = min(n, int(room[at]))
            out.append((i, start, part, sequence + at, int(size[at] - room[at])))
            room[at] -= part
            cost[at] += linear * part + quadratic * part**2
            start, n = start + part, n - part
    return out


def pack_documents(
    docs: DataFrame,
    *,
    json_path: str,
    ranks_path: str,
    capacity: int = 1024,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    window_ids: int = WINDOW_IDS,
) -> DataFrame:
    """Pieces of all documents and the sequences they are in; see the module docstring."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 36, 0
        window: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal used, window, held
            pieces = pack_window([x.size for _, x in window], capacity, linear, quadratic)
            rows = [
                (window[i][0], start, n, zlib.crc32(window[i][1][start : start + n].astype("<u4").tobytes()), window[i][1].size, base + used + s, at)
                for i, start, n, s, at in pieces
            ]
            used += 1 + max((p[3] for p in pieces), default=-1)
            window, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for block in blocks(batches):
            for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                ids = encode(text, json_path, ranks_path)
                window.append((doc, ids))
                held += ids.size
                if held >= window_ids:
                    yield flush()
        if window:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
