"""Operator 5: secret scan by one combined deterministic automaton.

All rules are compiled together into one automaton (see ``automata``), each reversed, which reads
every byte of every text once, from the end, and marks the bytes where a match of a rule begins.
From the leftmost mark of a rule its anchored automaton gives the match's longest end; marks inside
it are passed over, as in a leftmost, non-overlapping search.  The length of an ``assign`` value is
counted from the match's first acceptance, which is its first character.  Matches below the least
length are dropped, and what they cover isn't tried again.

Kinds ``assign``, ``access`` and ``hex`` are the base; the others are rules of formats that cloud
services and tools publish for their keys (private key headers, web tokens, prefixed tokens).

Defined results: null is an empty text; empty texts have no spans (empty string, and the hash of
it); repeated rows are scanned one by one; spans that start together are in the order of the kinds;
an empty table gives no rows; other columns are carried by ``redacted`` and not read by ``secrets``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automata
from .runtime import ship
from .textkernel import blocks, joined

# For each kind its rule, and the least length of the match (of the value, for assign).
RULES: dict[str, tuple[str, int]] = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]{16,}", 16),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    "prefixed": (r"(gh[opsu]_|glpat-|xox[abp]-|sk_live_|AIza)[A-Za-z0-9_-]+", 20),
}
BASE = ("assign", "access", "hex")
KINDS = tuple(RULES)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


@lru_cache(maxsize=1)
def machine() -> tuple[automata.Dfa, list[automata.Dfa]]:
    """The backward automaton of all rules, and each rule's anchored one."""
    rules = [r[0] for r in RULES.values()]
    return automata.compile(rules, reverse=True), [automata.compile([r], anchored=True) for r in rules]


def spans_of(column: pa.Array) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray]:
    """(spans, data, starts): per text the byte spans (start, kind, end) in order, and the block."""
    data, doc_start, _ = joined(column)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(doc_start.size)]
    found = automata.matches(*machine(), data)
    for r, (kind, (_, least)) in enumerate(RULES.items()):
        sure = [(a, e) for a, first, e in found[r] if (e - first + 1 if kind == "assign" else e - a) >= least]
        docs = np.searchsorted(doc_start, np.array([a for a, _ in sure], np.int64), side="right") - 1
        for doc, (a, e) in zip(docs.tolist(), sure, strict=True):
            out[doc].append((a, r, e))
    for x in out:
        x.sort()
    return out, data, doc_start


def points(data: np.ndarray, start: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans of one text as code point spans."""
    out, at, n = [], start, 0
    marks = sorted({b for s in spans for b in (s[0], s[2])})
    place = {}
    for m in marks:
        n += int(np.count_nonzero((data[at:m] & 0xC0) != 0x80))
        at = m
        place[m] = n
    for s, k, e in spans:
        out.append((place[s], k, place[e]))
    return out


def joined_spans(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of every text; see the module docstring."""
    ship(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = sha256(b"").hexdigest()
        for block in blocks(batches):
            found, data, start = spans_of(block.column("text"))
            rows = []
            for i, spans in enumerate(found):
                if not spans:
                    rows.append((0, 0, 0, none, "", 0))
                    continue
                spans = points(data, int(start[i]), spans)
                base = [s for s in spans if s[1] < len(BASE)]
                n = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                rows.append((*n, sha256(joined_spans(base, KINDS).encode()).hexdigest(), joined_spans(spans, KINDS), len(spans)))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by ``mark``; n_chars follows."""
    ship(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found, data, start = spans_of(block.column("text"))
            text = block.column("text").to_pylist()
            for i, spans in enumerate(found):
                if spans:
                    raw, out, at = text[i].encode(), [], 0
                    for s, _, e in spans:
                        s, e = s - int(start[i]), e - int(start[i])
                        if s >= at:
                            out += [raw[at:s], mark.encode()]
                        at = max(at, e)
                    text[i] = b"".join([*out, raw[at:]]).decode()
            place = block.schema.get_field_index("text")
            yield block.set_column(place, block.schema.field(place), pa.array(text, block.schema.field(place).type))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
