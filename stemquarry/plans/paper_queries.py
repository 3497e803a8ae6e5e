"""Queries over the data source for papers, with the stand-in decoders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import pagesource, pdftext
from .base import questions, query


def _papers(t, kind: str, **options: str) -> DataFrame:
    pagesource.register(t.spark)
    source = t.spark.read.format("papers").option("decoder", f"stemquarry.plans.standin:{kind}").option("kind", kind)
    return source.option("pathColumn", "page_id").option("contentColumn", "html").options(**options).load(t.path("pages"))


_BLOCKS = """(select cast(page_id as varchar) path, contains(html, 'lang="es"') locked, html, list_filter(list_transform(string_split_regex(html, '<[^<>]*>'), lambda x: trim(x, ' ')), lambda x: x <> '') bs from pages)"""
_LINES = f"(select path, unnest(bs) b, unnest(range(0, len(bs))) k from {_BLOCKS} where not locked)"


@query(f"""select path, cast(p as integer) page, array_to_string(bs[40 * p + 1:40 * p + 40], chr(10)) "text", null error from (select path, bs, unnest(range(0, (len(bs) + 39) // 40)) p from {_BLOCKS} where not locked)
    union all select path, null, null, 'ValueError: locked' from {_BLOCKS} where locked""")
def paper_pages(t):
    """SRC-07: text of the pages of papers, and the papers that can't be read."""
    return _papers(t, "pages")


@query(f"select path, cast(k // 40 as integer) page, cast(10 * (i - 1) as double) x, cast(12 * (k % 40) as double) y, w \"text\" from (select path, k, unnest(ws) w, unnest(range(1, len(ws) + 1)) i from (select path, k, list_filter(string_split(b, ' '), lambda x: x <> '') ws from {_LINES}))")
def paper_words(t):
    """SRC-08: positioned words."""
    return _papers(t, "words", errors="drop").drop("error")


@query(f"select path, cast(k // 40 as integer) page, cast(12 * (k % 40) + 480 * (k // 40) as double) y, b[1] \"text\", case when upper(b[1]) = b[1] and lower(b[1]) <> b[1] then 'bold' else 'plain' end font from {_LINES}")
def paper_glyphs(t):
    """SRC-09: glyphs with fonts and a running y: pages lie below one another."""
    g = _papers(t, "glyphs", errors="drop")
    return pdftext.running_y(g).select("path", "page", "y", "text", "font")


@query(f"""select path, cast(i - 1 as integer) "row", [regexp_replace(m, '<[^<>]*>', '', 'g'), cast(length(m) as varchar)] cells from
    (select path, unnest(ms) m, unnest(range(1, len(ms) + 1)) i from (select path, regexp_extract_all(html, '<li>(.*?)</li>', 1, 's') ms from {_BLOCKS} where not locked))""")
def paper_tables(t):
    """SRC-10: rows of tables."""
    return _papers(t, "tables", errors="drop").select("path", "row", "cells")


@query(f"select path, length(b) width, cast(60 + k as integer) height, md5(b) data from {_LINES} where length(b) >= 50 and length(b) * (60 + k) >= 5000")
def paper_images(t):
    """SRC-11: embedded images that are no smaller than the floor."""
    found = pdftext.large_images(_papers(t, "images", errors="drop"))
    return found.select("path", "width", "height", F.md5("data").alias("data"))


@query(f"""with f as (select cast(path as bigint) file_id, cast(k % 3 as bigint) n, list_sort(list({{'src': md5(b), 'alt': cast(length(b) as varchar)}})) figures from {_LINES} where length(b) >= 50 and length(b) * (60 + k) >= 5000 group by 1, 2)
    select conv_id, turn, list_transform(figures, lambda x: x.src || ':' || x.alt) figures from conversations left join f on conv_id = f.file_id and turn = f.n""")
def paper_figures(t):
    """SNK-10: images of papers as figures of their questions."""
    found = pdftext.large_images(_papers(t, "images", errors="drop"))
    figures = found.select(F.col("path").cast("long").alias("file_id"), ((F.col("height") - 60) % 3).cast("long").alias("number_int"), F.md5("data").alias("src"), F.col("width").cast("string").alias("alt"))
    q = questions(t).withColumn("number_int", F.col("pos"))
    return pdftext.with_figures(q, figures).select(F.col("file_id").alias("conv_id"), F.col("pos").alias("turn"), F.transform("figures", lambda x: F.concat_ws(":", x["src"], x["alt"])).alias("figures"))
