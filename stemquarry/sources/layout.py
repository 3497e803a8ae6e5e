"""SNK-01, SRC-21: the index as bucketed, sorted tables with bloom filters.

The reference's index looks rows up by six columns.  Here both tables are bucketed by ``file_id`` and
sorted in their buckets, so their join moves nothing; equality on any of the looked-up columns skips
row groups by Parquet's statistics or bloom filters.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .scratch import shared_folder

#: Columns that lookups are made by.
FILE_COLUMNS, QUESTION_COLUMNS = ("category", "year", "subject"), ("number", "type", "answer")


@dataclass
class Layout:
    spark: SparkSession
    files_table: str
    questions_table: str

    @property
    def files(self) -> DataFrame:
        return self.spark.table(self.files_table)

    @property
    def questions(self) -> DataFrame:
        return self.spark.table(self.questions_table)

    def drop(self) -> None:
        for t in (self.files_table, self.questions_table):
            self.spark.sql(f"drop table if exists {t}")


def write_layout(files: DataFrame, questions: DataFrame, buckets: int = 64, path: str | None = None, name: str | None = None, block_bytes: int = 16 << 20) -> Layout:
    """Both tables in ``buckets`` files each, below ``path`` (a shared folder) and in the catalog under ``name``.

    Rows are dealt to as many tasks as there are buckets first, else each task would write a file for
    each bucket.  On a corpus of any size ``buckets`` is its bytes over the size of a file.
    """
    spark = files.sparkSession
    path, name = path or shared_folder(spark, "layout"), name or f"index_{uuid.uuid4().hex[:12]}"
    for kind, rows, columns, order in (("files", files, FILE_COLUMNS, ["file_id"]), ("questions", questions, QUESTION_COLUMNS, ["file_id", "pos"])):
        writer = rows.repartition(buckets, "file_id").write.bucketBy(buckets, "file_id").sortBy(*order).format("parquet")
        writer = writer.option("path", f"{path}/{kind}").option("parquet.block.size", block_bytes)
        for c in columns:
            if c in rows.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "10000")
        writer.saveAsTable(f"{name}_{kind}")
    return Layout(spark, f"{name}_files", f"{name}_questions")
