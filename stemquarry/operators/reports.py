"""Aggregations over issues, changes, files and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """AGG-14: the first n rows of each group.  Spark limits each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """AGG-06: several rollups in one pass; absent keys are null."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggregates)


def share_of(flag: Column) -> Column:
    """AGG-16: percentage with a zero guard."""
    return F.coalesce(100.0 * F.count_if(flag) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


def group_quality(df: DataFrame, by: str, metrics: dict[str, Column]) -> DataFrame:
    """AGG-07: counts and percentages per group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[share_of(v).alias(k) for k, v in metrics.items()])


def against_mean_of_means(groups: DataFrame, by: str, value: str, excluded: str) -> DataFrame:
    """AGG-08: each group's value against the unweighted mean of all groups but one."""
    mean = groups.where(F.col(by) != excluded).agg(F.avg(value).alias("mean_of_means")).scalar()
    return groups.select(by, value, mean.alias("mean_of_means")).withColumn("difference", F.col(value) - F.col("mean_of_means"))


def pivot_counts(df: DataFrame, by: str, over: str, values: list[str]) -> DataFrame:
    """AGG-09: counts by value with a total, as conditional counts (no second pass)."""
    return df.groupBy(by).agg(*[F.count_if(F.col(over) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"))


def zero_filled(df: DataFrame, over: str, values: list[str]) -> DataFrame:
    """AGG-12: a histogram with a row for each listed value."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v,) for v in values], f"{over} string")
    seen = df.groupBy(over).agg(F.count("*").alias("n"))
    return F.broadcast(wanted).join(seen, over, "left").select(over, F.coalesce("n", F.lit(0)).alias("n"))


def by_description(issues: DataFrame, most: int = 10, shown: int = 5) -> DataFrame:
    """AGG-13: papers per description: all if at most ``most``, else the first ``shown``.

    Only the smallest ``most`` + 1 distinct papers of a description ever meet.
    """
    distinct = issues.select("detail", "path").distinct()
    total = distinct.groupBy("detail").agg(F.count("*").alias("n"))
    listed = first_n(distinct, ["detail"], ["path"], most).groupBy("detail").agg(F.array_sort(F.collect_list("path")).alias("papers"))
    return total.join(listed, "detail").select("detail", "n", F.when(F.col("n") <= most, F.col("papers")).otherwise(F.slice("papers", 1, shown)).alias("papers"))


def quality_score(issues: Column, files: Column) -> Column:
    """AGG-17: 100 less the issues per hundred files, not below 0; 100 without files."""
    return F.when(files > 0, F.greatest(F.lit(0.0), 100 - 100.0 * issues / files)).otherwise(F.lit(100.0))


#: Low bits that each level of a selection leaves out, by type: a level has no more than a few million counts a group.
_LEVELS = {"tinyint": (0,), "smallint": (0,), "int": (12, 0), "bigint": (42, 21, 0)}
#: Counts of a level of a selection among other numbers.
_WAYS = 4096


def upper_median(df: DataFrame, by: str, value: str, small_groups: bool = False) -> DataFrame:
    """AGG-26: the element at position len // 2 of the sorted values, nulls left out.

    A radix selection: rows are counted by the high bits of the value, and only those of the part that
    holds the middle are counted by the next bits, so no task sorts a group and all sums combine before
    the shuffle.  Numbers without bits (doubles, decimals) are counted in ``_WAYS`` steps between a
    group's ends, again and again until the middle step has one value.  ``small_groups`` counts all
    distinct values of a group at once, for groups as small as a page.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, value)
    kind = dict(rows.dtypes)[value]
    if kind not in _LEVELS and not small_groups:
        return _refined_median(rows, by, value)
    at = None
    for bits in (0,) if small_groups else _LEVELS[kind]:
        part = F.shiftright(value, bits) if bits else F.col(value)
        rows = rows.withColumn("_part", part)
        rows = rows.join(at, [by, "_high"]) if at is not None else rows.withColumn("_place", F.lit(None).cast("long"))
        counts = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.first("_place").alias("_place"))
        at = _middle(counts, by, "_part")
        rows = rows.drop("_place", "_high").withColumnRenamed("_part", "_high")
        at = at.withColumnRenamed("_part", "_high")
    return at.select(by, F.col("_high").alias("upper_median"))


def _middle(counts: DataFrame, by: str, part: str) -> DataFrame:
    """(by, part, _place): the part of each group that holds its place (the middle, where it has none yet), and the place in it."""
    group = Window.partitionBy(by)
    counts = counts.withColumn("_before", F.sum("_n").over(group.orderBy(part)) - F.col("_n"))
    counts = counts.withColumn("_place", F.coalesce("_place", F.floor(F.sum("_n").over(group) / 2)))
    return counts.where((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_n"))).select(by, part, (F.col("_place") - F.col("_before")).alias("_place"))


def _refined_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    from ..sources.scratch import saved

    v = F.col(value)
    ends = rows.groupBy(by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.floor(F.count("*") / 2).alias("_place"))
    while True:
        ends = saved(ends, "median")
        if not ends.where("_lo < _hi").limit(1).count():
            return ends.select(by, F.col("_lo").alias("upper_median"))
        inside = rows.join(ends, by).where(v.between(F.col("_lo"), F.col("_hi")))
        share = (v.cast("double") / 2 - F.col("_lo").cast("double") / 2) / (F.col("_hi").cast("double") / 2 - F.col("_lo").cast("double") / 2)  # halves can't overflow
        step = F.when(v == F.col("_hi"), _WAYS).otherwise(F.least(F.floor(share * _WAYS), F.lit(_WAYS - 1))).cast("int")
        counts = inside.groupBy(by, step.alias("_step")).agg(F.count("*").alias("_n"), F.min(v).alias("_least"), F.max(v).alias("_most"), F.first("_place").alias("_place"))
        at = _middle(counts, by, "_step").join(counts.select(by, "_step", "_least", "_most"), [by, "_step"])
        ends = at.select(by, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_place")


def coverage(df: DataFrame, by: str, year: str) -> DataFrame:
    """AGG-20: distinct years, first, last and rows per group, with a grand total (null group)."""
    return df.rollup(by).agg(F.count_distinct(year).alias("years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count("*").alias("n"))


def mean_per(df: DataFrame, by: str, inner: str, item: str) -> DataFrame:
    """AGG-21: mean number of distinct items per (group, inner)."""
    return df.groupBy(by, inner).agg(F.count_distinct(item).alias("_n")).groupBy(by).agg(F.avg("_n").alias("mean"))


def absent_in_few(df: DataFrame, by: str, year: str, most: int = 3) -> DataFrame:
    """AGG-23: groups that some years lack, at most ``most`` of them."""
    every = df.agg(F.array_sort(F.collect_set(year)).alias("_all")).scalar()
    own = df.groupBy(by).agg(F.collect_set(year).alias("_own")).withColumn("_all", every)
    return own.select(by, F.array_sort(F.array_except("_all", "_own")).alias("absent")).where(F.size("absent").between(1, most))


def spellings(df: DataFrame, name: str, normal: Column) -> DataFrame:
    """AGG-24: normalised names with more than one spelling."""
    return df.select(normal.alias("normal"), name).groupBy("normal").agg(F.array_sort(F.collect_set(name)).alias("spellings")).where(F.size("spellings") > 1)


def similarity_rollup(df: DataFrame, by: str, status: str, score: str) -> DataFrame:
    """AGG-18: passes, failures, not found, skipped; the mean covers passes and failures only."""
    s = F.col(status)
    return df.groupBy(by).agg(
        *[F.count_if(s == v).alias(f"n_{v}") for v in ("pass", "fail", "not_found", "skip")], F.avg(F.when(s.isin("pass", "fail"), F.col(score))).alias("mean_score")
    )
