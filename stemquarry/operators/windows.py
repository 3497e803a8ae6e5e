"""Sequence operators over ordered rows of a paper: numbering, runs, carry-forward, neighbours.

All of them partition by paper, so a group is one paper's questions or lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, by: str, number: str) -> DataFrame:
    """WIN-01: numbers that occur more than once, with their counts."""
    return df.groupBy(by, number).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def repeats(df: DataFrame, by: str, number: str, *order: str) -> DataFrame:
    """WIN-01 per repeat: all occurrences but the first."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(by, number).orderBy(*order))).where("occurrence > 1")


def missing_numbers(df: DataFrame, by: str, number: str) -> DataFrame:
    """WIN-02: numbers between a paper's first and last that it lacks."""
    seen = df.groupBy(by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.collect_set(F.col(number).cast("long")).alias("seen"))
    return seen.select(by, F.array_sort(F.array_except(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long")), "seen")).alias("missing")).where(F.size("missing") > 0)


def adjacent_gaps(df: DataFrame, by: str, number: str) -> DataFrame:
    """WIN-03: steps between neighbours that aren't 1: 0 repeats, more than 1 leaves a gap."""
    before = F.lag(number).over(Window.partitionBy(by).orderBy(number))
    return df.select(by, number, before.alias("before")).where(F.col(number) - F.col("before") != 1).withColumn("kind", F.when(F.col(number) == F.col("before"), "repeat").otherwise("gap"))


def continuous(df: DataFrame, by: str, number: str, *order: str) -> DataFrame:
    """WIN-04: whether a paper's numbers, in document order, count up from the first by one."""
    listed = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, number))).alias("_rows"))
    numbers = F.transform("_rows", lambda r: r[number].cast("long"))
    return listed.select(by, numbers.alias("numbers")).select(by, (F.col("numbers") == F.sequence(F.col("numbers")[0], F.col("numbers")[0] + F.size("numbers") - 1)).alias("continuous"))


def starts_late(df: DataFrame, by: str, number: str, first: int = 1) -> DataFrame:
    """WIN-05: papers whose least number isn't ``first``."""
    return df.groupBy(by).agg(F.min(number).alias("first_number")).where(F.col("first_number") != first)


def suffix_repeats(df: DataFrame, by: str, number: str, *order: str) -> DataFrame:
    """WIN-06: later occurrences become n-2, n-3 and so on."""
    at = F.row_number().over(Window.partitionBy(by, number).orderBy(*order))
    text = F.col(number).cast("string")
    return df.withColumn("_at", at).withColumn("new_number", F.when(F.col("_at") == 1, text).otherwise(F.concat_ws("-", text, F.col("_at").cast("string")))).drop("_at")


def keep_longest(df: DataFrame, by: list[str], text: str, *order: str) -> DataFrame:
    """WIN-07: of rows with equal keys, the longest text; the earlier one on ties."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.length(text)), *order))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def merge_texts(df: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """WIN-08: one text per key: later ones are appended unless they are contained already."""
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    merged = F.aggregate(
        F.transform(listed, lambda r: r[text]), F.lit(None).cast("string"),
        lambda acc, t: F.when(acc.isNull(), t).when(F.contains(acc, t), acc).otherwise(F.concat_ws("\n", acc, t)),
    )
    return df.groupBy(*by).agg(merged.alias(text))


def islands(df: DataFrame, by: str, number: str, flag: Column) -> DataFrame:
    """WIN-09: runs of successive numbers for which ``flag`` holds: first, last and length."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(number))
    return (
        df.where(flag).withColumn("_island", F.col(number) - at).groupBy(by, "_island")
        .agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_island")
    )


def segment_end(df: DataFrame, by: str, start: str, end: Column | None = None) -> DataFrame:
    """WIN-10: a segment ends where the next starts (the last at ``end``)."""
    return df.withColumn("segment_end", F.coalesce(F.lead(start).over(Window.partitionBy(by).orderBy(start)), end if end is not None else F.lit(None).cast("long")))


def carried(by: str, order: str, value: Column) -> Column:
    """WIN-11: the latest non-null value up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def group_id(by: str, order: str, starts: Column) -> Column:
    """WIN-13: rows belong to the latest start row; 0 before the first."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order))


def attach_lines(df: DataFrame, by: str, order: str, text: str, starts: Column, separator: str = "\n") -> DataFrame:
    """WIN-13: start lines with the lines that follow them, joined in order."""
    g = df.withColumn("segment", group_id(by, order, starts)).where("segment > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), separator)
    return g.groupBy(by, "segment").agg(F.min(order).alias(order), joined.alias(text))


def lines_by_gap(df: DataFrame, by: str, y: str, tolerance: float) -> DataFrame:
    """WIN-14 (words): a new line where the step from the last word is above the tolerance."""
    w = Window.partitionBy(by).orderBy(y)
    stepped = df.withColumn("_step", F.col(y) - F.lag(y).over(w))
    return stepped.withColumn("line", F.sum(F.when(F.col("_step") > tolerance, 1).otherwise(0)).over(w)).drop("_step")


def anchored_lines(df: DataFrame, by: str, y: str, text: str, tolerance: float = 2.0) -> DataFrame:
    """WIN-14 (characters): a line reaches from its first character's y by the tolerance."""
    rows = F.array_sort(F.collect_list(F.struct(y, text)))
    kind = "array<struct<y:double,text:string>>"
    folded = F.aggregate(
        rows, F.array().cast(kind),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.abs(r[y] - F.element_at(acc, -1)["y"]) <= tolerance),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["y"].alias("y"), F.concat(F.element_at(acc, -1)["text"], r[text]).alias("text")))),
        ).otherwise(F.concat(acc, F.array(F.struct(r[y].cast("double").alias("y"), r[text].alias("text"))))),
    )
    return df.groupBy(by).agg(folded.alias("lines")).select(by, F.posexplode("lines").alias("line", "l")).select(by, "line", "l.y", "l.text")


def paragraph_id(df: DataFrame, by: str, y: str, factor: float = 1.5, least: float = 30.0) -> DataFrame:
    """WIN-15: a paragraph starts where a gap exceeds max(factor x upper median gap, least)."""
    from .reports import upper_median

    w = Window.partitionBy(by).orderBy(y)
    gaps = df.withColumn("gap", F.col(y) - F.lag(y).over(w))
    middle = upper_median(gaps, by, "gap", small_groups=True)
    return gaps.join(middle, by, "left").withColumn("paragraph", F.sum(F.when(F.col("gap") > F.greatest(factor * F.col("upper_median"), F.lit(least)), 1).otherwise(0)).over(w)).drop("upper_median")


def neighbours(by: str, order: str, flag: Column, reach: int = 2) -> Column:
    """WIN-16: flagged rows within ``reach`` on both sides, the row itself not counted."""
    own = F.when(flag, 1).otherwise(0)
    return F.sum(own).over(Window.partitionBy(by).orderBy(order).rowsBetween(-reach, reach)) - own


def first_seen(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """WIN-17/19: the first row of each key."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_at = 1").drop("_at")


def changes(by: str, order: str, value: str) -> Column:
    """WIN-17: whether a row's value differs from the one before it (true for the first)."""
    return ~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(by).orderBy(order))) | (F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1)


def order_violations(df: DataFrame, by: str, order: str, late: Column, early: Column) -> DataFrame:
    """WIN-18: papers in which a row that belongs first stands behind one that belongs later."""
    g = df.groupBy(by).agg(F.max(F.when(early, F.col(order))).alias("last_early"), F.min(F.when(late, F.col(order))).alias("first_late"))
    return g.where("last_early > first_late")


def numeral_of(n: Column) -> Column:
    """WIN-20: numeral of 1 to 10, digits beyond."""
    table = F.array(*[F.lit(c) for c in "一二三四五六七八九十"])
    return F.when(n <= 10, F.get(table, n - 1)).otherwise(n.cast("string"))


def as_of_within(by: str, number: str, value: str, reach: int = 9) -> Column:
    """JOI-12: the value of the nearest earlier number within ``reach`` that has one."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(number).rangeBetween(-reach, -1))
