"""Corpus source: a tree of JSON papers to typed ``files`` and ``questions`` tables plus load issues.

Papers are read as whole files with explicit parsing: a file that isn't JSON becomes an issue row,
never a failed job.  ``number`` keeps its kind (int or string), ``options`` may be a map or a list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import saved

PAPER = "試題.json"

FILE_FIELDS = ("exam_name", "level", "subject", "exam_time", "code", "exam_type", "category")


def path_part(path: Column, from_end: int) -> Column:
    """The n-th directory name from the end (1 is the file's own directory)."""
    return F.element_at(F.split(path, "/"), -1 - from_end)


def minguo_year(name: Column) -> Column:
    """SRC-05: the year of a directory named like 112年, else null."""
    return F.nullif(F.regexp_extract(name, r"(\d{2,3})年$", 1), F.lit("")).cast("int")


def read_papers(spark: SparkSession, root: str, name: str = PAPER, exclude: tuple[str, ...] = ()) -> DataFrame:
    """SRC-01/03: (path, raw) of every file of that name below ``root``."""
    found = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("wholetext", True).text(root)
        .select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.regexp_replace("value", "^﻿", "").alias("raw"))
    )
    return found.where(~F.element_at(F.split("path", "/"), -1).isin(*exclude)) if exclude else found


def ordered_parts(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of its order, written once, with (_part, _at): a row's range and its place there.

    Spark cuts the ranges by a sample of rows over all order columns, so a value that many rows share is
    no range of its own.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = saved(placed, "ranges")  # an id by place must be read, not made again
    return placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def dense_ids(df: DataFrame, name: str, *order: str) -> DataFrame:
    """SNK-01: consecutive ids from 1 in global order without one big window.

    Rows are numbered by their place in a range of the order; the rows before each range come from one
    small aggregate (a row per range).  Rows equal in all order columns may swap ids between
    evaluations, and lie in one range: give columns that identify a row.
    """
    parts = ordered_parts(df, *order)
    before = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    return parts.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_at") + F.col("_before") + 1).cast("long")).drop("_part", "_at", "_before")


@dataclass
class Corpus:
    files: DataFrame
    questions: DataFrame
    issues: DataFrame


def text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def parse_papers(papers: DataFrame, keep_duplicates: bool = False) -> Corpus:
    """SRC-02/04/05/06: typed tables from (path, raw).  Either duplicate flag counts."""
    doc = papers.withColumn("doc", F.try_parse_json("raw"))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    issues = doc.where(~is_object).select(
        F.lit("load").alias("rule"), F.lit("P0").alias("severity"), "path", F.when(F.col("doc").isNull(), "not JSON").otherwise("root is no object").alias("detail")
    )
    ok = doc.where(is_object)
    flag = lambda p: F.coalesce(F.try_variant_get("doc", p, "boolean"), F.lit(False))
    ok = ok.withColumn("is_duplicate", flag("$._is_duplicate") | flag("$.metadata._is_duplicate"))
    if not keep_duplicates:
        ok = ok.where(~F.col("is_duplicate"))
    ok = dense_ids(ok, "file_id", "path")
    notes = F.coalesce(F.try_variant_get("doc", "$.notes", "array<string>"), F.array(text_of("doc", "$.notes")))
    year = F.coalesce(minguo_year(path_part(F.col("path"), 2)), F.regexp_extract(text_of("doc", "$.year"), r"^(\d{2,3})", 1).try_cast("int"))
    files = ok.select(
        "file_id", "path", F.coalesce(path_part(F.col("path"), 3), text_of("doc", "$.category")).alias("category"), year.alias("year"),
        F.coalesce(F.nullif(path_part(F.col("path"), 1), F.lit("")), text_of("doc", "$.subject")).alias("subject"),
        *[text_of("doc", f"$.metadata.{c}").alias(c) for c in ("exam_name", "level", "exam_time", "code")],
        F.filter(notes, lambda n: n.isNotNull()).alias("notes"), F.coalesce(F.try_variant_get("doc", "$.sections", "array<string>"), F.array()).alias("sections"),
        "is_duplicate", "raw",
    )
    items = ok.select("file_id", F.posexplode(F.try_variant_get("doc", "$.questions", "array<variant>")).alias("pos", "q"))
    questions = items.select("file_id", "pos", *question_columns(F.col("q")))
    return Corpus(files, questions, issues)


def question_columns(q: Column) -> list[Column]:
    """Typed columns of one question variant."""
    kind = F.schema_of_variant(F.try_variant_get(q, "$.number", "variant"))
    number = text_of(q, "$.number")
    as_list = F.try_variant_get(q, "$.options", "array<struct<label:string,text:string>>")
    from_list = F.map_from_entries(F.transform(as_list, lambda o: F.struct(o["label"], o["text"])))
    return [
        number.alias("number"),
        F.when(kind == "BIGINT", "int").when(kind == "STRING", "string").alias("number_kind"),
        F.when(kind == "BIGINT", number.try_cast("int")).alias("number_int"),
        text_of(q, "$.type").alias("type"),
        F.coalesce(text_of(q, "$.stem"), F.lit("")).alias("stem"),
        F.coalesce(F.try_variant_get(q, "$.options", "map<string,string>"), from_list).alias("options"),
        *[text_of(q, f"$.{c}").alias(c) for c in ("answer", "passage", "section", "subtype")],
        text_of(q, "$._note").alias("note"),
    ]


def option_columns(questions: DataFrame) -> DataFrame:
    """PRJ-01: the index layout, options as four columns, absent texts as ''."""
    o = lambda k: F.coalesce(F.col("options")[k], F.lit("")).alias(f"option_{k.lower()}")
    return questions.select(
        "file_id", "pos", "number", "type", "stem", *[o(k) for k in "ABCD"], F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("passage", F.lit("")).alias("passage"), F.coalesce("section", F.lit("")).alias("section")
    )


def text_fields(questions: DataFrame, *keys: str) -> DataFrame:
    """PRJ-02: (keys, field, text) of every non-empty text of a question."""
    plain = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("stem", "passage")])
    opts = F.coalesce(F.transform(F.map_entries("options"), lambda e: F.struct(F.concat(F.lit("option "), e["key"]).alias("field"), e["value"].alias("text"))), F.array())
    return questions.select(*keys, F.explode(F.concat(plain, opts)).alias("f")).select(*keys, "f.field", "f.text").where("coalesce(text, '') <> ''")


def last_per_paper(files: DataFrame) -> DataFrame:
    """SRC-06: of files with one (category, year, subject), the last path stays; incomplete ones go."""
    order = Window.partitionBy("category", "year", "subject").orderBy(F.desc("path"))
    return files.where("year is not null and category is not null and subject is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def find_papers(files: DataFrame, category: str | None = None, year: int | None = None, subject: str | None = None, stem_pattern: str | None = None) -> DataFrame:
    """SRC-21/22: lookup by path parts; ``stem_pattern`` is an ordered wildcard such as a*b*c."""
    for c, v in (("category", category), ("subject", subject)):
        files = files.where(F.contains(F.col(c), F.lit(v))) if v else files
    files = files.where(F.col("year") == year) if year is not None else files
    if stem_pattern:
        like = stem_pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        files = files.where(F.element_at(F.split("path", "/"), -1).like(f"%{like}%"))
    return files
