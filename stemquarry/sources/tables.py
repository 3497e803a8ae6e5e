"""Other sources: batch CSV, answer keys, dictionaries, replacement tables, listing pages, settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "json_path string, number string, stem string, option_a string, option_b string, option_c string, option_d string, answer string, passage string, section string"

#: Words of a dictionary that may be sent to every executor (about 20 bytes each).
DICTIONARY_WORDS = 500_000


def read_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: question rows from a CSV with a header; a byte order mark is dropped, columns go by name."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c: c.lstrip("﻿").strip() for c in raw.columns}
    raw = raw.withColumnsRenamed(names)
    fields = [f.split(" ")[0] for f in BATCH.split(", ")]
    return raw.select(*[(F.col(f) if f in raw.columns else F.lit(None).cast("string")).alias(f) for f in fields])


def read_answer_key(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: (number, answer) from a JSON object or a list of {number, answer}."""
    doc = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("doc"))
    flat = doc.select(F.explode(F.try_variant_get("doc", "$", "map<string,string>")).alias("number", "answer"))
    rows = doc.select(F.explode(F.try_variant_get("doc", "$", "array<struct<number:string,answer:string>>")).alias("r")).select("r.number", "r.answer")
    return flat.union(rows).where("answer is not null and trim(answer) <> ''")


def dictionary(spark: SparkSession, path: str, forced: tuple[str, ...] = (), forced_frequency: int = 100) -> dict[str, int]:
    """SRC-18: word frequencies from 'word[<tab>count]' lines, with forced short words.

    Raises where the list is larger than DICTIONARY_WORDS: such a list belongs in a join
    (operators.joins.known_words), not in a function.
    """
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("p[0] <> ''").select(F.lower(F.col("p")[0]).alias("word"), F.coalesce(F.get("p", F.lit(1)).try_cast("int"), F.lit(1)).alias("n"))
    return collected_words(rows.groupBy("word").agg(F.max("n").alias("n")), path) | {w: forced_frequency for w in forced}


def collected_words(words: DataFrame, source: str) -> dict[str, int]:
    """All of (word, n) as a dictionary; raises where there are more than DICTIONARY_WORDS."""
    rows = words.limit(DICTIONARY_WORDS + 1).collect()
    if len(rows) > DICTIONARY_WORDS:
        raise ValueError(f"{source} holds more than {DICTIONARY_WORDS} words")
    return {r.word: r.n for r in rows}


def replacement_table(path: str) -> list[tuple[str, str]]:
    """TXT-21/REP-18: ordered literal pairs from a tab-separated file (phrase tables are data)."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    return [tuple(line.split("\t", 1)) for line in lines if "\t" in line]


def exam_options(pages: DataFrame, html: str = "html", keyword: str | None = None, *keys: str) -> DataFrame:
    """SRC-14: (keys, value, label) of a listing page's options, optionally with a keyword in the label."""
    pairs = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(r'<option[^>]*value="[^"]*"[^>]*>[^<]*'), F.lit(0)),
        lambda x: F.struct(F.regexp_extract(x, 'value="([^"]*)"', 1).alias("value"), F.trim(F.regexp_extract(x, ">([^<]*)$", 1)).alias("label")),
    )
    out = pages.select(*keys, F.explode(pairs).alias("o")).select(*keys, "o.value", "o.label").where("value <> ''")
    return out.where(F.contains("label", F.lit(keyword))) if keyword else out


# Kinds of files behind a listing's links.
FILE_KINDS = {"Q": "question", "S": "answer", "M": "correction", "R": "reference"}


def download_links(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """SRC-15: (keys, code, kind, href) of a page's file links, one row each."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*[?&](?:amp;)?t=[QSMR][^"]*)"'), F.lit(1))
    kind = F.create_map(*[F.lit(x) for kv in FILE_KINDS.items() for x in kv])
    return pages.select(*keys, F.explode(hrefs).alias("href")).select(
        *keys, F.regexp_extract("href", r"[?&;]c=(\w+)", 1).alias("code"), kind[F.regexp_extract("href", r"[?&;]t=([QSMR])", 1)].alias("kind"), "href"
    )


def grouped_links(links: DataFrame, *keys: str) -> DataFrame:
    """SRC-15: links of one code together, kinds in order."""
    return links.groupBy(*keys, "code").agg(F.array_sort(F.collect_set(F.struct("kind", "href"))).alias("files"))


def uncached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """SRC-16: rows whose md5(url:path) the cache doesn't hold."""
    key = F.md5(F.concat_ws(":", "url", "path").cast("binary"))
    return wanted.withColumn("key", key).join(cache.select("key"), "key", "left_anti")


def download_status(attempts: DataFrame, cached: DataFrame, most: int = 5, least_bytes: int = 1024) -> DataFrame:
    """SRC-16: one row per file: what came of it, in how many attempts, after how many seconds of waiting.

    ``attempts(key, attempt, error, content_type, size)`` counts attempts from 0; the first without an
    error ends them.  A cached file over the least size is not fetched; a wrong type or too few bytes
    are no success and not tried again; after an error the wait doubles, from one second on.
    """
    ended = F.min(F.when(F.col("error").isNull() & (F.col("attempt") < most), F.struct("attempt", "content_type", "size"))).alias("end")
    tried = attempts.groupBy("key").agg(ended, F.least(F.max("attempt") + 1, F.lit(most)).alias("tried"), F.max_by("error", "attempt").alias("error"))
    c = cached.where(F.col("size") > least_bytes).select("key", F.col("size").alias("held"))
    rows = tried.join(c, "key", "full")
    kind = F.lower(F.coalesce("end.content_type", F.lit("")))
    status = (
        F.when(F.col("held").isNotNull(), "skipped").when(F.col("end").isNull(), "failed").when(~(F.contains(kind, F.lit("pdf")) | F.contains(kind, F.lit("octet-stream"))), "wrong type")
        .when(F.col("end.size") <= least_bytes, "too small").otherwise("done")
    )
    used = F.when(status == "skipped", 0).otherwise(F.coalesce(F.col("end.attempt") + 1, F.col("tried")))
    waits = F.when(status == "skipped", 0).otherwise(F.pow(F.lit(2), F.coalesce(F.col("end.attempt"), F.col("tried") - 1)) - 1).cast("long")
    return rows.select("key", status.alias("status"), used.cast("int").alias("attempts"), waits.alias("waited"), F.when(status == "done", F.col("end.size")).when(status == "skipped", F.col("held")).alias("size"))


def settings(path: str | None = None) -> dict[str, str]:
    """SRC-24: KEY=VALUE lines of a file, overridden by the environment."""
    found: dict[str, str] = {}
    if path and Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            if "=" in line and not line.lstrip().startswith("#"):
                k, v = line.split("=", 1)
                found[k.strip()] = v.strip().strip("'\"")
    return found | {k: os.environ[k] for k in found if k in os.environ}
