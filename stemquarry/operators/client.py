"""Operators of the reader's page: card search, subject view, bookmarks, practice scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def card_search(cards: DataFrame, text: str, *, query: str, year_prefix: str | None = None, bookmarks: DataFrame | None = None, key: str = "card") -> DataFrame:
    """CLI-01/02/06: cards that hold the query, with the number of highlights."""
    if bookmarks is not None:
        cards = cards.join(bookmarks.select(key), key, "left_semi")
    if year_prefix:
        cards = cards.where(F.startswith(key, F.lit(year_prefix)))
    return cards.withColumn("hits", tx.occurrences(text, query)).where("hits > 0")


def subject_view(cards: DataFrame, subject: str, year: str) -> DataFrame:
    """CLI-04: subjects with their years, newest first."""
    return cards.groupBy(subject).agg(F.sort_array(F.collect_set(year), asc=False).alias("years"), F.count("*").alias("cards"))


def practice_score(clicks: DataFrame, user: str, question: str, at: str, picked: str, right: str) -> DataFrame:
    """CLI-07: the first pick per question counts; equality is exact."""
    first = clicks.groupBy(user, question).agg(F.min_by(F.struct(picked, right), at).alias("f"))
    return first.groupBy(user).agg(F.count_if(F.col(f"f.{picked}") == F.col(f"f.{right}")).alias("correct"), F.count("*").alias("total")).withColumn("pct", tx.percent("correct", "total"))


def history(sessions: DataFrame, user: str, at: str, n: int = 20) -> DataFrame:
    """CLI-08: the newest n sessions of each user."""
    w = Window.partitionBy(user).orderBy(F.desc(at))
    return sessions.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def next_hit(current: int, total: int, step: int) -> int:
    """CLI-03: next or previous hit with wraparound."""
    return (current + step) % total if total else -1


def walked_hits(steps: DataFrame, by: str, at: str, step: str, total: str) -> DataFrame:
    """CLI-03 as rows: the hit shown after each step (+1 or -1) of a reader, from before the first on."""
    sofar = F.sum(step).over(Window.partitionBy(by).orderBy(at)) - 1
    return steps.withColumn("hit", F.when(F.col(total) > 0, F.pmod(sofar, F.col(total))).otherwise(-1))


def visible(cards: DataFrame, *, query: str, text: str, answers: bool = False) -> DataFrame:
    """CLI-09: the cards that a query leaves visible, with or without their answers."""
    found = card_search(cards, text, query=query)
    return found if answers else found.drop("answer")


def export_visible(cards: DataFrame, path: str, *, query: str, text: str, answers: bool = False) -> None:
    """CLI-09: write the cards that a query leaves visible, with or without their answers."""
    visible(cards, query=query, text=text, answers=answers).write.mode("error").json(path)
