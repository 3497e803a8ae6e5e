"""Set operations: fingerprints, overlaps, key differences, canonical identity, span suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(number: str, stem: str, n: int = 50) -> Column:
    """SET-01: number and the first n characters of the stem."""
    return F.concat_ws("|", F.col(number).cast("string"), F.substring(stem, 1, n))


def overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, once: bool = False) -> DataFrame:
    """SET-01/02: shared keys with set sizes, common / max and common / min.

    Only pairs that share a key meet, in an equi-join on it; ``once`` keeps pairs with left < right and is
    part of the join, for a table against itself.  A key that many ids share makes a pair of each two
    of them, as the result asks for: leave out keys that say nothing (empty stems) beforehand.
    """
    a = left.select(left_id, key).distinct()
    b = right.select(right_id, key).distinct()
    met = a.join(b, (a[key] == b[key]) & (a[left_id] < b[right_id])).drop(b[key]) if once else a.join(b, key)
    common = met.groupBy(left_id, right_id).agg(F.count("*").alias("common"))
    sizes = lambda df, c, name: df.groupBy(c).agg(F.count("*").alias(name))
    out = common.join(sizes(a, left_id, "n_left"), left_id).join(sizes(b, right_id, "n_right"), right_id)
    return out.withColumns({"of_max": F.col("common") / F.greatest("n_left", "n_right"), "of_min": F.col("common") / F.least("n_left", "n_right")})


def overlap_class(of_min: Column) -> Column:
    """SET-02."""
    return F.when(of_min > 0.8, "same").when(of_min > 0.2, "partial").otherwise("different")


def key_difference(left: Column, right: Column) -> Column:
    """SET-03/04: keys of one side only."""
    return F.struct(F.array_sort(F.array_except(left, right)).alias("missing"), F.array_sort(F.array_except(right, left)).alias("extra"))


def identity_hash(*columns: Column | str) -> Column:
    """SET-07: hash of the canonical JSON of nested values."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def flag_copies(df: DataFrame, content: Column, key: str, salts: int = 16) -> DataFrame:
    """SET-07/REP-19: rows with equal content point at the smallest key; the first is no copy.

    The first key per hash is a map-side aggregate.  Only contents that repeat are joined back, each
    once for every salt, so the rows of one content that is copied very often go to ``salts`` tasks.
    """
    hashed = df.withColumn("_hash", identity_hash(content))
    first = hashed.groupBy("_hash").agg(F.min(key).alias("copy_of"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select("_hash", "copy_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    rows = hashed.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts))).join(first, ["_hash", "_salt"], "left")
    rows = rows.withColumn("copy_of", F.coalesce("copy_of", key))
    return rows.withColumn("is_copy", F.col("copy_of") != F.col(key)).drop("_hash", "_salt")


def suppress_overlaps(spans: Column) -> Column:
    """SET-06: of spans (start, end, ...) sorted by start, one that overlaps a kept one, or equals it, is dropped."""
    return F.aggregate(
        F.slice(F.array_sort(spans), 2, 1 << 30), F.slice(F.array_sort(spans), 1, 1),
        lambda kept, s: F.when(s["start"] >= F.element_at(kept, -1)["end"], F.concat(kept, F.array(s))).otherwise(kept),
    )


def distinct_issues(issues: DataFrame) -> DataFrame:
    """SET-05."""
    return issues.dropDuplicates([c for c in ("rule", "path", "number", "field", "detail") if c in issues.columns])
