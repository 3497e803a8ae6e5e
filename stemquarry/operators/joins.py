"""Joins: answer keys, overlays, anti joins, ranges, best matches, containment, dictionaries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.corpus import dense_ids
from ..sources.scratch import saved


def fill_from_key(rows: DataFrame, key: DataFrame, on: list[str], value: str, overwrite: bool = False) -> DataFrame:
    """JOI-02/03/10: fill absent values (or overwrite) from a key table; unmatched rows stay."""
    k = key.select(*on, F.col(value).alias("_key"))
    order = ("_key", value) if overwrite else (value, "_key")
    return rows.join(k, on, "left").withColumn(value, F.coalesce(*order)).drop("_key")


def overlay(sources: list[DataFrame], on: list[str], value: str, dropped: str = "#") -> DataFrame:
    """JOI-04: later sources beat earlier ones, except with ``dropped``; rows without a value go."""
    ranked = reduce(DataFrame.unionByName, [s.select(*on, value, F.lit(i).alias("_p")) for i, s in enumerate(sources)])
    usable = F.col(value).isNotNull() & (F.trim(value) != "") & (F.col(value) != dropped)
    return ranked.where(usable).groupBy(*on).agg(F.max_by(value, "_p").alias(value))


def missing_from(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """JOI-05: rows of ``left`` without a partner."""
    return left.join(right.select(*on), on, "left_anti")


def insert_absent(rows: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """JOI-06: ``new`` rows whose key is not there yet are added."""
    return rows.unionByName(missing_from(new, rows, on))


def spread_ranges(ranges: DataFrame, rows: DataFrame, by: str, low: str, high: str, number: str) -> DataFrame:
    """JOI-08: rows whose number lies in a range of their paper, as an equi-join on each number."""
    exploded = ranges.withColumn(number, F.explode(F.sequence(F.col(low).cast("long"), F.col(high).cast("long"))))
    return rows.withColumn(number, F.col(number).cast("long")).join(exploded, [by, number])


def pairs_within(df: DataFrame, on: list[str], key: str) -> DataFrame:
    """JOI-07: pairs (i < j) of different keys that share the group columns.

    Of several rows with one (group, key) the greatest stands for it (as the last of an ordered reading
    does).  Groups are sets of categories of one subject and year, a handful each; the comparison is
    asked for, not a shortcut.
    """
    rest = [c for c in df.columns if c not in (*on, key)]
    if rest:
        df = df.groupBy(*on, key).agg(F.max(F.struct(*rest)).alias("_last")).select(*on, key, "_last.*")
    else:
        df = df.distinct()
    left = df.select(*on, F.col(key).alias(f"{key}_a"), *[F.col(c).alias(f"{c}_a") for c in df.columns if c not in (*on, key)])
    right = df.select(*on, F.col(key).alias(f"{key}_b"), *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in (*on, key)])
    return left.join(right, on).where(F.col(f"{key}_a") < F.col(f"{key}_b"))


#: Ids of one key that travel as one list; a key with more has several lists.
SLICE_IDS = 4096
#: Ids that one left id may meet to be counted in one place; beyond it Spark counts its pairs.
MET_IDS = 1_000_000


@F.pandas_udf(T.StructType([T.StructField("code", T.LongType()), T.StructField("shared", T.LongType())]))
def _commonest(lists: pd.Series) -> pd.DataFrame:
    """The commonest of the codes of each row, the least of equally common ones."""
    best = []
    for codes in lists:
        code, n = np.unique(codes, return_counts=True)
        i = int(n.argmax())
        best.append((int(code[i]), int(n[i])))
    return pd.DataFrame(best, columns=["code", "shared"])


def best_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: list[str], order: str, slice_ids: int = SLICE_IDS, met_ids: int = MET_IDS) -> DataFrame:
    """JOI-11: for each left id the right id with most shared keys; the first in order on ties.

    The right ids of a key travel as a list (by their number in the order), and a left id counts the
    lists that it meets, so no row is made for a pair.  A key with more than ``slice_ids`` ids has its
    list cut by a hash of the id; a left id that meets more than ``met_ids`` is counted pair by pair
    in an aggregate instead, so no task holds an unbounded list.
    """
    lefts = left.select(left_id, *on).distinct()
    pairs = saved(right.select(right_id, F.col(order).alias("_order"), *on).distinct(), "pairs")
    codes = saved(dense_ids(pairs.select(right_id, "_order").distinct(), "_code", "_order", right_id), "codes")
    coded = pairs.join(codes, [right_id, "_order"]).select(*on, "_code")
    sizes = saved(pairs.groupBy(*on).agg(F.count("*").alias("_n")), "sizes")
    wide = sizes.where(F.col("_n") > slice_ids)
    cut = F.pmod(F.xxhash64("_code"), F.ceil(F.col("_n") / slice_ids)) if wide.limit(1).count() else F.lit(0)
    coded = coded.join(wide, on, "left") if wide.limit(1).count() else coded
    lists = saved(coded.withColumn("_slice", F.coalesce(cut, F.lit(0))).groupBy(*on, "_slice").agg(F.collect_list("_code").alias("_codes")), "lists")
    met = lefts.join(sizes, on).groupBy(left_id).agg(F.sum("_n").alias("_met"))
    busy = saved(met.where(F.col("_met") > met_ids).select(left_id), "busy")
    calm = lefts.join(busy, left_id, "left_anti") if busy.limit(1).count() else lefts
    best = calm.join(lists, on).groupBy(left_id).agg(F.flatten(F.collect_list("_codes")).alias("_all")).select(left_id, _commonest("_all").alias("_best"))
    best = best.select(left_id, F.col("_best.code").alias("_code"), F.col("_best.shared").alias("shared"))
    if busy.limit(1).count():
        counted = lefts.join(busy, left_id, "left_semi").join(lists, on).select(left_id, F.explode("_codes").alias("_code")).groupBy(left_id, "_code").agg(F.count("*").alias("shared"))
        first = counted.groupBy(left_id).agg(F.min(F.struct((-F.col("shared")).alias("lost"), "_code")).alias("_best"))  # combines before the shuffle
        best = best.unionByName(first.select(left_id, F.col("_best._code").alias("_code"), (-F.col("_best.lost")).alias("shared")))
    return best.join(codes.select("_code", right_id), "_code").select(left_id, right_id, "shared")


def side_by_side(left: DataFrame, right: DataFrame, on: list[str], value: str, keep_missing: bool = False) -> DataFrame:
    """JOI-13: both sides' values by key; missing partners are kept where asked for."""
    return left.select(*on, F.col(value).alias("left_value")).join(right.select(*on, F.col(value).alias("right_value")), on, "left" if keep_missing else "inner")


def contained(phrases: DataFrame, texts: DataFrame, on: str, phrase: str, text: str) -> DataFrame:
    """JOI-14: phrases of a document that stand in the same document's text."""
    return phrases.join(texts, on).where(F.contains(F.col(text), F.col(phrase)))


def known_words(tokens: DataFrame, words: DataFrame, token: str, word: str) -> DataFrame:
    """JOI-15: tokens that a dictionary holds (Spark broadcasts the dictionary if it is small)."""
    return tokens.join(words.select(F.col(word).alias(token)).distinct(), token, "left_semi")


def presence(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """JOI-16: keys of either side with flags for both."""
    a = left.select(on).distinct().withColumn("in_left", F.lit(True))
    b = right.select(on).distinct().withColumn("in_right", F.lit(True))
    f = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return a.join(b, on, "full").select(on, f("in_left"), f("in_right"))


def with_reference(rows: DataFrame, reference: DataFrame, on: list[str], columns: list[str], when: Column) -> DataFrame:
    """JOI-09: take columns from a clean reference paper where a condition holds."""
    r = reference.select(*on, *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = rows.join(r, on, "left")
    for c in columns:
        out = out.withColumn(c, F.when(when & F.col(f"_r_{c}").isNotNull(), F.col(f"_r_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_r_{c}" for c in columns])
