"""Registration of queries: a name, a Spark callable and, where SQL can say it, the DuckDB text.

The driver's tables stand in for corpus tables: ``conversations`` for questions (paper conv_id,
number turn, type role, stem text), ``documents`` for texts with facets, ``labels`` for an answer
key, ``benchmark`` for reference texts, ``pages`` for HTML, ``lineitem`` for (paper, number).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """t(name) reads a table, t.path(name) is where it lies."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(sql: str | None = None):
    """Register a function (t) -> DataFrame over ``Tables``."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def questions(t) -> DataFrame:
    """Conversations as questions with the index layout."""
    c = t("conversations")
    return c.select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("number"), F.col("role").alias("type"), F.col("text").alias("stem"),
        *[F.lit("").alias(f"option_{k}") for k in "abcd"], F.lit("").alias("answer"), F.lit("").alias("passage"),
    )


def doc_questions(t) -> DataFrame:
    """Documents as questions: the label quality is the answer, the language the type."""
    d = t("documents").join(t("labels"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("file_id"), F.lit(0).alias("pos"), F.col("doc_id").cast("string").alias("number"), F.col("lang").alias("type"), F.col("text").alias("stem"),
        F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("answer"), "source",
    )


def doc_files(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("category"), (F.col("n_chars") % 10 + 100).cast("int").alias("year"), F.col("lang").alias("subject"))
