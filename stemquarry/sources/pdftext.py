"""Binary papers as rows of text, positioned words, glyphs or images.

Decoding needs a PDF library, which is the caller's choice: every reader takes a function from the
file's bytes to plain Python rows.  Files are read and decoded where they lie (one file is one row,
so a task holds one decoded file at a time).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = "path string, page int, text string"
WORD = "path string, page int, x double, y double, text string"
GLYPH = "path string, page int, x double, y double, text string, font string, height double"
IMAGE = "path string, page int, width int, height int, data binary"


def read_binary(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(F.url_decode("path").alias("path"), "content")


def decoded(files: DataFrame, decode: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``decode`` for each file behind its path; a file that fails gives no rows (see failed)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = decode(bytes(content))
                except Exception:  # noqa: BLE001  any decoder error marks the file, see failed()
                    continue
                yield pd.DataFrame([(path, *r) for r in rows], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def pages(files: DataFrame, decode: Callable[[bytes], list[tuple]]) -> DataFrame:
    """SRC-07: (path, page, text)."""
    return decoded(files, decode, PAGE)


def words(files: DataFrame, decode: Callable[[bytes], list[tuple]]) -> DataFrame:
    """SRC-08: positioned words."""
    return decoded(files, decode, WORD)


def glyphs(files: DataFrame, decode: Callable[[bytes], list[tuple]]) -> DataFrame:
    """SRC-09: glyphs with a running y: pages lie below one another."""
    return running_y(decoded(files, decode, GLYPH))


def running_y(g: DataFrame) -> DataFrame:
    """SRC-09: glyphs (path, page, y, height, ...) with pages below one another; the sums run over pages, not glyphs."""
    height = g.groupBy("path", "page").agg(F.max("height").alias("_h"))
    above = height.withColumn("_above", F.sum("_h").over(Window.partitionBy("path").orderBy("page")) - F.col("_h"))
    return g.join(above, ["path", "page"]).withColumn("y", F.col("y") + F.col("_above")).drop("_h", "_above")


def images(files: DataFrame, decode: Callable[[bytes], list[tuple]], side: int = 50, area: int = 5000) -> DataFrame:
    """SRC-11: embedded images that are no smaller than the floor."""
    return large_images(decoded(files, decode, IMAGE), side, area)


def large_images(rows: DataFrame, side: int = 50, area: int = 5000) -> DataFrame:
    return rows.where((F.col("width") >= side) & (F.col("height") >= side) & (F.col("width") * F.col("height") >= area))


def failed(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files without a decoded row."""
    return files.select("path").join(rows.select("path").distinct(), "path", "left_anti")


def page_documents(rows: DataFrame) -> DataFrame:
    """(path, text): pages in order, joined by line breaks."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda r: r["text"]), "\n")
    return rows.groupBy("path").agg(text.alias("text"))


def with_figures(questions: DataFrame, figures: DataFrame) -> DataFrame:
    """SNK-10: figures (file_id, number_int, src, alt) as an array on their questions."""
    own = figures.groupBy("file_id", "number_int").agg(F.array_sort(F.collect_list(F.struct("src", "alt"))).alias("figures"))
    return questions.join(own, ["file_id", "number_int"], "left")
