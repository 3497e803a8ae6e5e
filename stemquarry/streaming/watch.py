"""Streaming extension: new papers are checked as they arrive, by the same rules as in batch.

Per-paper rules stay inside one row (array functions), because windows over rows are not allowed
on streams.  Practice events get tumbling counts with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules
from ..sources import corpus


def paper_stream(spark: SparkSession, root: str, name: str = corpus.PAPER) -> DataFrame:
    """(path, raw) of each new paper below ``root``."""
    raw = (
        spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("wholetext", True).schema("value string").text(root)
    )
    return raw.select(F.url_decode("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def issues_of(papers: DataFrame) -> DataFrame:
    """Load, question and numbering issues of each paper, row by row."""
    doc = papers.withColumn("doc", F.try_parse_json("raw"))
    items = doc.where("doc is not null").select("path", F.explode(F.try_variant_get("doc", "$.questions", "array<variant>")).alias("q")).select("path", *corpus.question_columns(F.col("q")))
    numbers = F.filter(F.transform(F.try_variant_get("doc", "$.questions", "array<variant>"), lambda q: F.try_variant_get(q, "$.number", "int")), lambda n: n.isNotNull())
    gaps = F.array_except(F.sequence(F.array_min(numbers), F.array_max(numbers)), numbers)
    numbering = doc.where("doc is not null").where(F.size(numbers) > 0).select("path", F.lit("numbers.gap").alias("rule"), F.lit("P1").alias("severity"), F.array_join(gaps, ",").alias("detail")).where("detail <> ''")
    broken = doc.where("doc is null").select("path", F.lit("load").alias("rule"), F.lit("P0").alias("severity"), F.lit("not JSON").alias("detail"))
    return rules.apply(items, rules.question_rules(), "path").unionByName(numbering).unionByName(broken)


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, then stop; the checkpoint makes it exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts per key; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
