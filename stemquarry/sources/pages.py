"""HTML pages as a source: counts, ids, links and embedded data by patterns (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def tag_count(html: Column, tag: str) -> Column:
    """SRC-13: opening tags of a kind."""
    return F.regexp_count(html, F.lit(f"<{tag}[ >]")).cast("long")


def links(html: Column) -> Column:
    """SRC-13: href values in order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def element_ids(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'\bid="([^"]*)"'), F.lit(1))


def embedded_json(html: Column, name: str, schema: str) -> Column:
    """SRC-13: a JSON array assigned to a script variable."""
    return F.from_json(F.regexp_extract(html, rf"(?s){name}\s*=\s*(\[.*?\]);", 1), schema)


def paragraphs(html: Column) -> Column:
    """Inner texts of plain paragraphs."""
    return F.regexp_extract_all(html, F.lit(r"<p>([^<]*)</p>"), F.lit(1))


def page_counts(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    return pages.select(
        "page_id",
        title(h).alias("title"),
        tag_count(h, "p").alias("n_p"),
        tag_count(h, "a").alias("n_a"),
        tag_count(h, "script").alias("n_script"),
        F.size(links(h)).cast("long").alias("n_links"),
        F.length(h).cast("long").alias("n_chars"),
    )
