"""Operator 4: personal data by fixed formats and a linear-chain CRF over word shapes.

The base formats (email, ip, card, phone) are found at their anchors: an at sign, runs of digits
and dots, runs of digits and separators, a plus sign.  Anchors come from array passes over the
bytes of a block, and each candidate is cut in linear time, leftmost and non-overlapping per kind.

The CRF adds spans that those formats miss: numbers without a country prefix, card numbers with a
wrong check digit, addresses in brackets and the like.  Its features are the shapes of a word and
its neighbours (letters and digits as classes, with run lengths), digit counts and neighbouring
words.  It is trained here on a small labelled table that ``labelled_rows`` generates by rule, and
decoded by Viterbi in numpy batches over windows: words that hold a digit or an at sign and three
words to either side (other words are outside by definition); a window of over ``LONGEST`` words is
decoded in pieces that overlap by ``OVERLAP`` words to either side.  A span of the CRF is kept where it
overlaps no base span and no earlier one; base spans always stay.

Defined results: null is an empty text; empty texts have no spans (empty string, and the hash of
it); repeated rows are scanned one by one; spans that start together are in the order of the kinds;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .runtime import ship
from .secret_dfa import joined_spans, points
from .textkernel import BLANK, blocks, class_table, joined, runs

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

_DIGIT = class_table(b"0123456789")
_LOCAL = class_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = class_table(b"0123456789.")
_SPACED = class_table(b"0123456789 -")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) byte spans of a block, in order within each kind."""
    raw, out = data.tobytes(), []

    at = np.flatnonzero(data == 64)
    if at.size:
        other = np.flatnonzero(~_LOCAL[data])  # each at sign is one of them
        begin = np.concatenate(([-1], other))[np.searchsorted(other, at)] + 1
        done = 0
        for p, b in zip(at.tolist(), begin.tolist(), strict=True):
            b = max(b, done)
            if b < p and (m := _DOMAIN.match(raw, p + 1)):
                out.append((b, 0, m.end()))
                done = m.end()

    start, end = runs(_DOTTED[data])
    dots = np.concatenate(([0], np.cumsum(data == 46)))
    pick = dots[end] - dots[start] >= 3
    for s, e in zip(start[pick].tolist(), end[pick].tolist(), strict=True):
        parts = raw[s:e].split(b".")
        place = np.cumsum([0, *(len(p) + 1 for p in parts)]).tolist()
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if not all(four):
                i += 1
                continue
            if all(len(p.lstrip(b"0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((s + place[i], 1, s + place[i + 3] + len(four[3])))
            i += 4

    start, end = runs(_SPACED[data])
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    pick = digits[end] - digits[start] >= 14
    for s, e in zip(start[pick].tolist(), end[pick].tolist(), strict=True):
        for m in _CARD.finditer(raw, s, e):
            number = m[0].replace(b" ", b"").replace(b"-", b"")
            if 14 <= len(number) <= 19 and luhn(number):
                out.append((m.start(), 2, m.end()))

    plus = np.flatnonzero((data[:-1] == 43) & _DIGIT[data[1:]]) if data.size else np.empty(0, np.int64)
    for p in plus.tolist():
        if (m := _PHONE.match(raw, p)) and 10 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            out.append((p, 3, m.end()))
    return out


# ---- the CRF ----

#: Hashed feature dimensions; the model is this many rows of five weights.
DIMENSIONS = 1 << 13
REACH = 3
#: Words of a piece of a long window, and the words that it also sees to either side.
LONGEST, OVERLAP = 512, 16


@lru_cache(maxsize=65536)
def shape(word: bytes) -> str:
    """Letters as a run mark, digits with their run length (up to 5), other ASCII as itself."""
    out = re.sub(rb"[A-Za-z\x80-\xff]+", b"a", word[:64])
    return re.sub(rb"[0-9]+", lambda m: b"%dd" % min(len(m[0]), 20) if len(m[0]) > 4 else b"9" * len(m[0]), out).decode("ascii")


@lru_cache(maxsize=65536)
def _own(word: bytes) -> tuple[str, str, str]:
    n = sum(48 <= c <= 57 for c in word)
    text = word.strip(b".,;:()").lower()
    return shape(word.rstrip(b",;:!?")), f"{min(n, 20)}{b'@' in word:d}{word.count(b'.')}{word[:1] == b'+':d}", text.decode("latin-1") if not n else "#"


def feature_ids(words: list[bytes]) -> list[list[int]]:
    """Hashed feature ids of each word of one sequence."""
    mark = [("^", "^", "^")]
    own = mark * 2 + [_own(w) for w in words] + mark * 2
    out = []
    for i in range(2, len(own) - 2):
        (s, d, w), (s1, d1, w1), (s2, d2, _), (r1, e1, x1), (r2, e2, _) = own[i], own[i - 1], own[i - 2], own[i + 1], own[i + 2]
        names = (
            f"s={s}", f"d={d}", f"w={w}", f"s-1={s1}", f"s+1={r1}", f"d-1={d1}", f"d+1={e1}", f"w-1={w1}", f"w+1={x1}",
            f"ss-={s1}|{s}", f"ss+={s}|{r1}", f"dd={d1}|{d}|{e1}", f"d--={d2}|{d1}|{d}", f"d++={d}|{e1}|{e2}", f"sss={s1}|{s}|{r1}", "b",
        )
        out.append([crc32(n.encode()) % DIMENSIONS for n in names])
    return out


def labelled_rows(n: int = 400, seed: int = 7) -> list[tuple[list[bytes], list[int]]]:
    """The labelled table: word lists with a state per word (0 outside, then the kinds from 1)."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "in", "the", "on", "sch", "es", "ció", "le", "ou", "st", "re")) for _ in range(r.randint(1, 4)))
    user = lambda: r.choice((word(), digits(2), f"{word()}.{word()}", f"{word()}{digits(2)}")).encode().decode()
    byte = lambda: str(r.randint(0, 255))
    kinds = (
        (1, lambda: f"{user()}@{word()}.{r.choice(('com', 'org', 'net', 'de'))}"),
        (1, lambda: f"{user()}@{word()}{digits(1)}.{word()}.com"),
        (1, lambda: f"<{user()}@{word()}.org>"),
        (1, lambda: f"{user()}@{word()}"),
        (2, lambda: ".".join(byte() for _ in range(4))),
        (2, lambda: "[" + ".".join(byte() for _ in range(4)) + "]"),
        (2, lambda: ".".join(byte() for _ in range(4)) + f":{r.randint(80, 9999)}"),
        (3, lambda: digits(16)),
        (3, lambda: digits(16)),
        (3, lambda: digits(15)),
        (3, lambda: " ".join(digits(4) for _ in range(4))),
        (3, lambda: "-".join(digits(4) for _ in range(4))),
        (4, lambda: f"+{r.randint(1, 9)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        (4, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        (4, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        (4, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        (4, lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"),
        (4, lambda: f"+{r.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}"),
    )
    plain = (
        lambda: str(r.randint(1900, 2040)), lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"{r.randint(1, 9)},{digits(3)}.{digits(2)}", lambda: f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}",
        lambda: f"#{digits(5)}", lambda: f"{digits(2)}%", lambda: f"{r.randint(1, 99)}-{r.randint(100, 300)}", lambda: str(r.randint(0, 99999)), lambda: digits(r.randint(22, 30)),
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", lambda: f"978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
        lambda: f"${digits(3)}", lambda: f"v{digits(1)}", lambda: f"@{word()}", lambda: f"{digits(6)}",
    )
    rows = []
    for _ in range(n):
        words, states = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 5)):
                words.append(word())
                states.append(0)
            if r.random() < 0.6:
                k, make = r.choice(kinds)
            else:
                k, make = 0, r.choice(plain)
            new = make().split(" ")
            if r.random() < 0.2:
                new[-1] += r.choice(".,;")
            words += new
            states += [k] * len(new)
        rows.append(([w.encode() for w in words], states))
    return rows


class Model:
    def __init__(self, weights: np.ndarray, move: np.ndarray):
        self.weights, self.move = weights, move

    def decode(self, sequences: list[list[bytes]]) -> list[np.ndarray]:
        """Best states of each sequence."""
        ids = [feature_ids(s) for s in sequences]
        first = np.concatenate(([0], np.cumsum([len(s) for s in sequences]))).astype(np.int64)
        emit = self.weights[np.array([x for s in ids for x in s], np.int64).reshape(-1, 16)].sum(axis=1) if first[-1] else np.zeros((0, 5))
        return np.split(crf.viterbi(emit, first, self.move), first[1:-1])


@lru_cache(maxsize=2)
def train(rows: int = 400, seed: int = 7, steps: int = 80) -> Model:
    """Fit by gradient ascent on the regularised log-likelihood of the labelled table."""
    table = labelled_rows(rows, seed)
    ids = np.array([x for words, _ in table for x in feature_ids(words)], np.int64)
    state = np.array([s for _, states in table for s in states], np.int64)
    first = np.concatenate(([0], np.cumsum([len(s) for _, s in table]))).astype(np.int64)
    weights, move = np.zeros((DIMENSIONS, 5)), np.zeros((5, 5))
    adam, n = crf.Adam(0.1), len(state)
    for _ in range(steps):
        adam.t += 1
        emit = weights[ids].sum(axis=1)
        seen, pairs, _ = crf.marginals(emit, first, move)
        _, count = crf.score_of(state, emit, first, move)
        diff = -seen
        diff[np.arange(n), state] += 1
        grad = np.stack([np.bincount(ids.ravel(), np.repeat(diff[:, k], ids.shape[1]), DIMENSIONS) for k in range(5)], axis=1) / n
        adam.step("w", weights, grad - 1e-4 * weights)
        adam.step("m", move, (count - pairs) / n - 1e-4 * move)
    return Model(weights.astype(np.float32), move.astype(np.float32))


def _windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(word starts, word ends, [from, to) word ranges around words with a digit or an at sign)."""
    start, end = runs(~BLANK[data])
    marked = np.concatenate(([0], np.cumsum(_DIGIT[data] | (data == 64))))
    hot = np.flatnonzero(marked[end] > marked[start])
    if not hot.size:
        return start, end, []
    gap = np.flatnonzero(np.diff(hot) > 2 * REACH) + 1
    low, high = hot[np.concatenate(([0], gap))], hot[np.concatenate((gap - 1, [hot.size - 1]))]
    return start, end, [(max(0, a - REACH), min(start.size, b + REACH + 1)) for a, b in zip(low.tolist(), high.tolist(), strict=True)]


def crf_spans(model: Model, data: np.ndarray, doc_start: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs of words with one state, cut at text ends and trimmed of punctuation."""
    start, end, ranges = _windows(data)
    if not ranges:
        return []
    raw = data.tobytes()
    doc = np.searchsorted(doc_start, start, side="right")
    sequences, places, inner = [], [], []
    for a, b in ranges:
        cuts = [a, *(np.flatnonzero(np.diff(doc[a:b])) + a + 1).tolist(), b]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            places.append((x, len(sequences)))
            for at in range(x, y, LONGEST):
                low, high = max(x, at - OVERLAP), min(y, at + LONGEST + OVERLAP)
                sequences.append([raw[s:e] for s, e in zip(start[low:high].tolist(), end[low:high].tolist(), strict=True)])
                inner.append((at - low, min(y, at + LONGEST) - low))
    out = []
    pieces = [states[a:b] for states, (a, b) in zip(model.decode(sequences), inner, strict=True)]
    numbers = [*(n for _, n in places), len(pieces)]
    for (x, _), n, m in zip(places, numbers[:-1], numbers[1:], strict=True):
        i = 0
        states = np.concatenate(pieces[n:m]).tolist()
        while i < len(states):
            j = i
            while j < len(states) and states[j] == states[i]:
                j += 1
            if states[i]:
                s, e = int(start[x + i]), int(end[x + j - 1])
                while e > s and raw[e - 1 : e] in (b".", b",", b";", b":", b"!", b"?", b">", b"]"):
                    e -= 1
                while s < e and raw[s : s + 1] in (b"<", b"[", b'"', b"'"):
                    s += 1
                if any(48 <= c <= 57 or c == 64 for c in raw[s:e]):
                    out.append((s, states[i] - 1, e))
            i = j
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of every text; see the module docstring."""
    ship(docs.sparkSession)
    model = train()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = sha256(b"").hexdigest()
        for block in blocks(batches):
            data, doc_start, _ = joined(block.column("text"))
            base: list[list[tuple[int, int, int]]] = [[] for _ in range(doc_start.size)]
            more: list[list[tuple[int, int, int]]] = [[] for _ in range(doc_start.size)]
            for found, to in ((base_spans(data), base), (crf_spans(model, data, doc_start), more)):
                where = np.searchsorted(doc_start, np.array([s[0] for s in found], np.int64), side="right") - 1
                for d, s in zip(where.tolist(), found, strict=True):
                    to[d].append(s)
            rows = []
            for d, own in enumerate(base):
                if not own and not more[d]:
                    rows.append((0, 0, 0, 0, none, "", 0))
                    continue
                both = sorted(own)
                edges = sorted((s, e) for s, _, e in own)
                taken_to, at = 0, 0
                for s, k, e in sorted(more[d]):
                    while at < len(edges) and edges[at][0] < e:
                        taken_to = max(taken_to, edges[at][1])
                        at += 1
                    if s >= taken_to:
                        both.append((s, k, e))
                        taken_to = e
                start = int(doc_start[d])
                base_text = joined_spans(points(data, start, sorted(own)), KINDS)
                n = [sum(s[1] == k for s in own) for k in range(4)]
                rows.append((*n, sha256(base_text.encode()).hexdigest(), joined_spans(points(data, start, sorted(both)), KINDS), len(both)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
