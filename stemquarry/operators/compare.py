"""Comparison of two renditions of a document: similarity, edits, coverage, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs


def gate(score: Column, same: float = 0.95, misaligned: float = 0.3) -> Column:
    """CMP-03."""
    return F.when(score > same, "same").when(score < misaligned, "misaligned").otherwise("different")


def question_similarity(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """CMP-01/03, JOI-13: similarity of questions with one key, equal texts without a comparison."""
    j = left.select(*on, F.col("text").alias("a")).join(right.select(*on, F.col("text").alias("b")), on)
    a, b = (tx.comparison_key(udfs.nfkc(c)) for c in "ab")
    keyed = j.select(*on, "a", "b", a.alias("ka"), b.alias("kb"))
    score = F.when(F.col("ka") == F.col("kb"), F.lit(1.0)).otherwise(udfs.ratio("ka", "kb"))
    return keyed.select(*on, score.alias("score"), gate(score).alias("status"), "a", "b")


def anchored_similarity(stem: str, segment: str, threshold: float = 0.85) -> Column:
    """CMP-04: similarity to the segment's start, else to the text behind the stem's first characters."""
    n = F.length(stem)
    direct = udfs.ratio_exact(F.col(stem), F.substring(segment, F.lit(1), n))
    at = F.greatest(*[F.position(F.substring(stem, 1, k), F.col(segment)) for k in (20, 10)])
    again = udfs.ratio_exact(F.col(stem), F.substring(F.col(segment), F.greatest(at, F.lit(1)), n))
    return F.when(direct >= threshold, direct).otherwise(F.greatest(direct, again))


def coverage(phrases: DataFrame, texts: DataFrame, on: str, phrase: str, text: str) -> DataFrame:
    """JOI-14, TXT-33, CMP-05: containment level of each phrase in its own document's text."""
    return phrases.join(texts, on).withColumn("level", tx.containment_level(phrase, text))


def fingerprint_coverage(lines: DataFrame, texts: DataFrame, on: str, line: str, text: str) -> DataFrame:
    """CMP-06: lines whose 30, 15 or 10 first characters stand in the text."""
    hit = F.lit(False)
    for n in (30, 15, 10):
        hit = hit | ((F.length(line) >= n) & F.contains(F.col(text), F.substring(line, 1, n)))
    return lines.join(texts, on).withColumn("covered", hit)


def document_rollup(results: DataFrame, by: str) -> DataFrame:
    """CMP-07."""
    return results.groupBy(by).agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "same").alias("same"), F.count_if(F.col("status") != "same").alias("differing"))


def edits(left: str, right: str) -> Column:
    """CMP-02."""
    return udfs.differences(left, right)
