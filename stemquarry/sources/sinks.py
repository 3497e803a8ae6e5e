"""Sinks: index tables, versioned corpora, change logs, issue reports, statistics.

Nothing here overwrites what it reads; a repaired corpus goes to a new version directory.
"""

from __future__ import annotations

import logging
import uuid
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus


def build_index(spark: SparkSession, papers: corpus.Corpus, path: str, partition: bool = True) -> tuple[DataFrame, DataFrame]:
    """SNK-01: the two index tables as Parquet, questions clustered by file for pruning joins."""
    files = papers.files.select("file_id", "path", "category", "year", "subject", "exam_name", "level")
    w = files.write.mode("overwrite")
    (w.partitionBy("year") if partition else w).parquet(f"{path}/files")
    corpus.option_columns(papers.questions).sortWithinPartitions("file_id", "pos").write.mode("overwrite").parquet(f"{path}/questions")
    return spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/questions")


def write_version(df: DataFrame, root: str, version: str | None = None) -> str:
    """SNK-02/04: a new immutable version directory; earlier ones stay as backups."""
    path = f"{root}/{version or uuid.uuid4().hex}"
    df.write.mode("error").json(path)
    return path


def changed(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """SNK-03: rows of ``new`` that differ from ``old`` in a column, nulls compared as values."""
    differs = ~F.lit(True)
    for c in columns:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return new.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left").where(differs).select("n.*")


def change_log(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """SNK-05: (keys, field, before, after) of every changed cell, in one join and one explode."""
    joined = old.alias("o").join(new.alias("n"), keys)
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("before"), F.col(f"n.{c}").cast("string").alias("after")) for c in columns])
    return joined.select(*keys, F.explode(cells).alias("c")).where(~F.col("c.before").eqNullSafe(F.col("c.after"))).select(*keys, "c.*")


def issue_report(issues: DataFrame, examples: int = 5) -> DataFrame:
    """SNK-06: one JSON row per rule: count, papers, first examples.

    Examples are the smallest by path; at most ``examples`` rows a rule are kept before they meet.
    """
    from ..operators.reports import first_n

    totals = issues.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("path").alias("papers"))
    shown = first_n(issues, ["rule"], ["path", "detail"], examples).groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("path", "detail"))).alias("examples"))
    return totals.join(shown, "rule").select(F.to_json(F.struct("rule", "severity", "n", "papers", "examples")).alias("json"))


def text_report(issues: DataFrame) -> str:
    """SNK-07: a short plain report; only the per-rule totals reach the driver."""
    rows = issues.groupBy("severity", "rule").count().orderBy("severity", F.desc("count"), "rule").collect()
    return "\n".join(["severity  rule  count", *(f"{r.severity}  {r.rule}  {r['count']}" for r in rows)])


def run_stats(files: DataFrame, questions: DataFrame) -> DataFrame:
    """SNK-09: one row of run statistics."""
    from ..operators.search import totals

    return totals(files, questions)


def formatted(questions: DataFrame) -> DataFrame:
    """SNK-12: console text of a question, a star on the right option."""
    option = lambda k: F.when(F.coalesce(F.col(f"option_{k.lower()}"), F.lit("")) != "", F.concat(F.when(F.col("answer") == k, "* ").otherwise("  "), F.lit(f"({k}) "), F.col(f"option_{k.lower()}")))
    head = F.format_string("[%s] %s", F.col("number"), F.col("stem"))
    return questions.select("*", F.concat_ws("\n", head, *[option(k) for k in "ABCD"]).alias("formatted"))


def rendered_cards(questions: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-08: one HTML card per paper: questions in order, options, essays (markup only, no styling)."""
    from ..functions import text as tx

    esc = lambda c: tx.escape_html(F.coalesce(c, F.lit("")))
    opts = F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(F.lit('<div class="mc-opt" data-val="'), e["key"], F.lit('">'), esc(e["value"]), F.lit("</div>"))), "")
    body = F.concat(
        F.lit('<div class="q-block" data-qnum="'), "number", F.lit('" data-answer="'), F.coalesce("answer", F.lit("")), F.lit('"><div class="'),
        F.when(F.col("type") == "essay", "essay-question").otherwise("mc-question"), F.lit('">'), esc(F.col("stem")), F.lit("</div>"), F.coalesce(opts, F.lit("")), F.lit("</div>"),
    )
    cards = questions.select("file_id", F.struct("pos", body.alias("html")).alias("q")).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["html"]), "").alias("body"))
    card = F.concat(F.lit('<div class="subject-card" id="'), tx.card_id("year", "subject"), F.lit('">'), "body", F.lit("</div>"))
    return files.join(cards, "file_id").select("file_id", "category", "year", "subject", card.alias("html"))


def rendered_pages(cards: DataFrame, by: str = "category") -> DataFrame:
    """SNK-08: (by, papers, html): the page of each category: a list of its cards, newest year first, then the cards."""
    from ..functions import text as tx

    ordered = F.array_sort(F.collect_list(F.struct((-F.coalesce("year", F.lit(0))).alias("newest"), "subject", "file_id", F.col("year"), "html")))
    esc = lambda c: tx.escape_html(F.coalesce(c.cast("string"), F.lit("")))
    entry = lambda r: F.concat(F.lit("<li>"), esc(r["year"]), F.lit(" "), esc(r["subject"]), F.lit("</li>"))
    body = F.concat(
        F.lit("<html><head><title>"), esc(F.col(by)), F.lit("</title></head><body><ul>"), F.array_join(F.transform("rows", entry), ""), F.lit("</ul>"),
        F.array_join(F.transform("rows", lambda r: r["html"]), ""), F.lit("</body></html>"),
    )
    return cards.groupBy(by).agg(ordered.alias("rows")).select(by, F.size("rows").alias("papers"), body.alias("html"))


def logger(path: str, size: int = 1 << 20, keep: int = 3) -> logging.Logger:
    """SNK-11: a rotating log on the driver."""
    log = logging.getLogger("stemquarry")
    if not log.handlers:
        handler = RotatingFileHandler(path, maxBytes=size, backupCount=keep, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def save_progress(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """SNK-13: a small keyed table, written as a new snapshot."""
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
