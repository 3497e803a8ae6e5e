"""Operator 1: document quality from a linear-chain CRF over lines.

Every line gets a vector of surface measures (lengths, shares of character kinds, repetition), its
own and those of the lines before and after it.  A two-state CRF labels lines bad or good.  Labels
exist for documents only, so training starts from the document's label on each line and then, once
fitted, gives back to the good state those lines of bad documents that the model itself holds for
good (the worst line of a bad document stays bad), and fits again.  A document's raw quality is the
mean forward-backward marginal of the good state, weighted by line length; a logistic curve fitted
on the same training documents turns its log odds into the score.

Training reads at most ``max_labelled`` labelled documents (a hash sample) whose fold is not held
out, one row for each id, and of these the ones with at most ``MAX_LINES`` lines.  Their line
features are made where the texts are read; they are all that the driver receives.  Scoring reads
every whole text.

Defined results: null or empty text is one empty line and is scored like any other; a document with
a null id is scored and not held out; repeated rows are scored one by one; repeated labels of a
document count once (the smallest); without two classes of labels every score is the share of
label 1, or 0.5 where there are none; an empty table gives no rows; clashing columns of the label
table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .runtime import fresh, ship
from .textkernel import BLANK, LOWER, blocks, class_table, joined, runs, span_hashes

SCHEMA = "doc_id long, score double, n_lines long, raw_quality double"
#: Labelled documents used for fitting, at most.
MAX_LABELLED = 4000
#: Lines of a document that is used for fitting, at most.
MAX_LINES = 400
#: Score from which a document is predicted good.
CUT = 0.3

_KINDS = {
    "upper": class_table(bytes(range(65, 91))),
    "lower": class_table(bytes(range(97, 123))),
    "digit": class_table(b"0123456789"),
    "blank": BLANK,
    "stop": class_table(b".,;:?'\"()-"),
    "symbol": class_table(b"!#$%&*+/<=>@[\\]^_`{|}~"),
    "wide": np.arange(256) >= 128,
}


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, first line of each document, bytes per line)."""
    data, doc_start, doc_end = joined(column)
    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    first = np.append(np.searchsorted(line_start, doc_start), line_start.size)
    size = line_end - line_start
    n = np.maximum(size, 1).astype(np.float64)

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, line_start, dtype=np.int32) if flags.size else np.zeros(0, np.int32)

    count = {k: per_line(table[data]) for k, table in _KINDS.items()}
    count["blank"] = count["blank"] - 1  # the newline itself

    start, end = runs(~BLANK[data])
    word = span_hashes(LOWER[data], start, end)
    at = np.searchsorted(line_start, start, side="right") - 1
    words = np.bincount(at, minlength=size.size)
    key = np.sort((at.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
    new = np.concatenate(([True], key[1:] != key[:-1])) if key.size else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=size.size)
    again = np.zeros(word.size, bool)
    again[1:] = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
    again = np.bincount(at[again], minlength=size.size)

    doc = np.repeat(np.arange(first.size - 1), np.diff(first))
    whole = span_hashes(data, line_start, line_end)
    order = np.lexsort((whole, doc))
    same = np.zeros(whole.size, bool)
    same[1:] = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    group = np.cumsum(~same) - 1
    copies = np.empty(whole.size)
    copies[order] = np.bincount(group)[group] if whole.size else 0

    w = np.maximum(words, 1)
    letters = np.maximum(count["upper"] + count["lower"] + count["wide"] / 2, 1)
    own = np.stack(
        [
            np.log1p(size),
            size == 0,
            count["upper"] / letters,
            count["digit"] / n,
            count["blank"] / n,
            count["stop"] / n,
            count["symbol"] / n,
            np.minimum(count["symbol"] / w, 3.0),
            count["wide"] / n,
            np.minimum(n / w, 30) / 10,
            distinct / w,
            again / w,
            (distinct / w) * np.log1p(words),
            np.log1p(copies - 1),
            words < 3,
        ],
        axis=1,
    ).astype(np.float64)
    is_first = np.zeros(len(own), bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(len(own), bool)
    is_last[first[1:] - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[is_first] = 0
    after[is_last] = 0
    lines = np.diff(first)[doc]
    features = np.concatenate([own, before, after, np.stack([is_first, is_last, np.log1p(lines), np.ones(len(own))], axis=1)], axis=1)
    return features, first, n


class Model:
    """CRF weights, feature scaling and the calibration curve."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights = prior, None

    def raw(self, x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Length-weighted marginal of the good state for each document."""
        good, _ = crf.binary_marginals(((x - self.mean) / self.spread) @ self.weights, first, self.move, with_pairs=False)
        return np.add.reduceat(good * n, first[:-1]) / np.add.reduceat(n, first[:-1])

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, lines, raw quality) of each text."""
        x, first, n = line_features(column)
        if self.weights is None:
            raw = np.full(first.size - 1, self.prior)
            return raw, np.diff(first), raw
        raw = self.raw(x, first, n)
        odds = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / np.clip(1 - raw, 1e-6, 1 - 1e-6))
        return 1 / (1 + np.exp(-(self.slope * odds + self.shift))), np.diff(first), raw

    def fit(self, x: np.ndarray, first: np.ndarray, n: np.ndarray, quality: np.ndarray, *, rounds: int = 3, steps: int = 60, decay: float = 1e-3) -> Model:
        """Fit on the lines of documents with labels 0 or 1; see the module docstring for the rounds.

        Two states need one weight for each feature: the good state's less the bad one's.
        """
        self.prior = float(quality.mean()) if quality.size else 0.5
        if np.unique(quality).size < 2:
            return self
        doc = np.repeat(np.arange(quality.size), np.diff(first))
        self.mean, self.spread = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-6
        self.mean[-1], self.spread[-1] = 0.0, 1.0
        self.weights, self.move = np.zeros(x.shape[1]), np.zeros((2, 2))
        z = (x - self.mean) / self.spread
        state = quality[doc].astype(np.int64)
        for turn in range(rounds):
            adam = crf.Adam(0.05)
            _, count = crf.score_of(state, np.zeros((len(state), 2)), first, self.move)
            for _ in range(steps):
                adam.t += 1
                seen, pairs = crf.binary_marginals(z @ self.weights, first, self.move)
                half = self.weights / 2  # of the good state; the bad one's is its negative
                adam.step("w", half, (z.T @ (state - seen)) / len(z) - decay * half)
                self.weights = 2 * half
                adam.step("m", self.move, (count - pairs) / len(z) - decay * self.move)
            if turn < rounds - 1:
                bad = 1 - crf.binary_marginals(z @ self.weights, first, self.move, with_pairs=False)[0]
                level = np.maximum.reduceat(bad, first[:-1])[doc]
                state = np.where((quality[doc] == 0) & (bad >= np.minimum(0.5, level)), 0, 1)
        raw = self.raw(x, first, n)
        odds = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / np.clip(1 - raw, 1e-6, 1 - 1e-6))
        self.slope, self.shift = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic regression on one variable
            p = 1 / (1 + np.exp(-(self.slope * odds + self.shift)))
            v = p * (1 - p)
            h = np.array([[(v * odds * odds).sum() + 1e-2, (v * odds).sum()], [(v * odds).sum(), v.sum() + 1e-2]])
            g = np.array([((quality - p) * odds).sum() - 1e-2 * self.slope, (quality - p).sum() - 1e-2 * self.shift])
            move = np.linalg.solve(h, g)
            self.slope, self.shift = self.slope + float(np.clip(move[0], -1, 1)), self.shift + float(np.clip(move[1], -1, 1))
        return self


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most ``max_labelled`` labelled documents outside the held-out fold."""
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where(~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            x, first, n = line_features(block.column("text"))
            lines = np.diff(first)
            raw = [(x[a:b].astype("<f4").tobytes(), n[a:b].astype("<f4").tobytes()) if b - a <= MAX_LINES else (None, None) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("quality"), pa.array(lines.astype(np.int64)), *(pa.array([r[k] for r in raw], pa.binary()) for k in (0, 1))],
                names=["doc_id", "quality", "lines", "features", "sizes"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))), "doc_id")
    rows = picked.mapInArrow(run, "doc_id long, quality long, lines long, features binary, sizes binary").where("features is not null")
    found = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "lines", "features", "sizes")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id").to_pydict()
    n = np.frombuffer(b"".join(found["sizes"]), "<f4").astype(np.float64)
    x = np.frombuffer(b"".join(found["features"]), "<f4").reshape(n.size, -1 if n.size else 1)
    return Model().fit(x, np.concatenate(([0], np.cumsum(np.array(found["lines"], np.int64)))), n, np.array(found["quality"], np.float64))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_lines, raw_quality) of every row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            score, lines, raw = model.scores(block.column("text"))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(score), pa.array(lines.astype(np.int64)), pa.array(raw)], names=["doc_id", "score", "n_lines", "raw_quality"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with its score as a last column, ``quality_score`` or, where that name is taken, the same
    with underscores behind it; all columns are carried through the scoring pass."""
    ship(docs.sparkSession)
    name = fresh(docs, "quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.append_column(name, pa.array(model.scores(block.column("text"))[0]))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def good_documents(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``cut``, all columns as they are."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.filter(pa.array(model.scores(block.column("text"))[0] >= cut))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, raw_quality) for every document."""
    model = fit_model(docs, labels, max_labelled)
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_lines", "raw_quality"
    )
