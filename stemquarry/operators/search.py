"""Keyword and facet search, statistics and sampling over questions and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_COLUMNS = ("stem", "option_a", "option_b", "option_c", "option_d", "passage")


def like_pattern(text: str, wildcards: bool = False) -> str:
    """A contains-pattern; % and _ are literal unless ``wildcards``."""
    return "%" + (text if wildcards else text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")) + "%"


def contains(column: str, text: str, wildcards: bool = False) -> Column:
    """FIL-03: case-insensitive substring."""
    return F.col(column).ilike(like_pattern(text, wildcards))


def conjunction(parts: list[Column]) -> Column:
    """FIL-06: all optional predicates, true where there are none."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def keyword(text: str, columns: tuple[str, ...] = TEXT_COLUMNS, wildcards: bool = False) -> Column:
    """FIL-05: the text stands in any of the columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(contains(c, text, wildcards), F.lit(False)) for c in columns])


def search(
    questions: DataFrame,
    files: DataFrame,
    text: str | None = None,
    *,
    year: int | None = None,
    category: str | None = None,
    subject: str | None = None,
    answer: str | None = None,
    qtype: str | None = "choice",
    limit: int | None = 20,
    wildcards: bool = False,
    numeric_order: bool = False,
    text_columns: tuple[str, ...] = TEXT_COLUMNS,
) -> DataFrame:
    """JOI-01, FIL-01..06, ORD-01: matching questions with their file's facets, newest year first.

    Facet filters are applied to the files before the join and text filters to the questions, so
    both reach their scans.  Numbers order as text unless ``numeric_order``; ids break ties.
    """
    on_files = [F.col("year") == year] if year is not None else []
    on_files += [contains(c, v) for c, v in (("category", category), ("subject", subject)) if v]
    on_questions = [F.col("type") == qtype] if qtype is not None else []
    on_questions += [F.col("answer") == answer] if answer is not None else []
    on_questions += [keyword(text, text_columns, wildcards)] if text else []
    found = questions.where(conjunction(on_questions)).join(files.where(conjunction(on_files)), "file_id")
    number = F.col("number").try_cast("int") if numeric_order else F.col("number")
    order = [F.desc_nulls_last("year"), F.asc_nulls_last("category"), number.asc_nulls_last(), F.asc("file_id"), F.asc("pos")]
    return found.orderBy(*order).limit(limit) if limit is not None else found


def totals(files: DataFrame, questions: DataFrame) -> DataFrame:
    """AGG-01: one row: files, questions, choice, essay, in one aggregate over both tables."""
    rows = files.select(F.lit("file").alias("kind")).unionByName(
        questions.select(F.when(F.col("type").isin("choice", "essay"), F.col("type")).otherwise("other").alias("kind"))
    )
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return rows.agg(n("file").alias("files"), n("choice", "essay", "other").alias("questions"), n("choice").alias("choice"), n("essay").alias("essay"))


def counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """AGG-02..04, 11: rows per group."""
    return df.groupBy(*by).agg(F.count("*").alias(name))


def mixed(seed: int, *key: str) -> Column:
    """A seeded order of rows by their key: it doesn't depend on partitions, and repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def random_rows(found: DataFrame, n: int, *key: str, seed: int = 42, first: int | None = 1000) -> DataFrame:
    """ORD-02/04: n random rows, of the first ``first`` ones in order (None: of all); ``key`` identifies a row."""
    pool = found.limit(first) if first is not None else found
    return pool.orderBy(mixed(seed, *key), *key).limit(n)


def stratified_sample(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """ORD-03: max(1, n // groups) rows of each group, then others, n in all.

    Rows order by a seeded hash of their key, so the sample is the same on every run.
    """
    from .reports import first_n

    groups = df.select(by).distinct().count()
    ordered = df.withColumn("_mix", mixed(seed, key))
    first = first_n(ordered, [by], ["_mix", key], max(1, n // max(1, groups))).withColumn("_own", F.lit(0))
    rest = ordered.join(first.select(key), key, "left_anti").withColumn("_own", F.lit(1))
    return first.unionByName(rest).orderBy("_own", by, "_mix", key).limit(n).drop("_mix", "_own")
