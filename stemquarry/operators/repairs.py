"""Repairs: DataFrame to DataFrame, deterministic and idempotent; deleted rows are returned too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

OPTION = r"[(（]([A-D])[)）]\s*((?:(?![(（][A-D][)）])(?s:.))+)"


def labelled_options(text: Column) -> Column:
    """REP-01: labels and texts of a run A, B, C(, D) of markers, from the last A on."""
    tail = F.regexp_extract(text, r"(?s).*([(（]A[)）].*)$", 1)
    labels = F.regexp_extract_all(tail, F.lit(OPTION), F.lit(1))
    values = F.transform(F.regexp_extract_all(tail, F.lit(OPTION), F.lit(2)), lambda v: F.trim(v))
    n = F.size(labels)
    run = labels == F.slice(F.array(*[F.lit(k) for k in "ABCD"]), 1, F.greatest(n, F.lit(1)))
    return F.when((n >= 3) & (n <= 4) & run, F.map_from_arrays(labels, values))


def split_stem(questions: DataFrame) -> DataFrame:
    """REP-01: options that stand in the stem move to the options; other rows stay as they are."""
    found = labelled_options(F.col("stem"))
    needs = (F.coalesce(F.size("options"), F.lit(0)) <= 0) | F.col("options").isNull()
    cut = F.trim(F.regexp_extract("stem", r"(?s)^(.*)[(（]A[)）].*$", 1))
    return questions.withColumn("_o", F.when(needs & (F.col("type") == "choice"), found)).withColumns(
        {"stem": F.when(F.col("_o").isNotNull(), cut).otherwise(F.col("stem")), "options": F.coalesce("_o", "options")}
    ).drop("_o")


PASSAGE = r"(?s)^(.*?)\s*(?:請(?:依下文|閱讀下文|依據下列|回答下列)[^\n]*?第?\s*(\d+)\s*題?\s*(?:至|到|~|-|–)\s*第?\s*(\d+)\s*題)(.*)$"


def move_passages(questions: DataFrame) -> DataFrame:
    """REP-07: a passage that leaked into the last option goes to the questions of its range."""
    last = F.element_at(F.array_sort(F.map_keys("options")), -1)
    leak = F.col("options")[last]
    low, high = (F.regexp_extract(leak, PASSAGE, g).try_cast("int") for g in (2, 3))
    has = F.coalesce(leak.rlike(PASSAGE), F.lit(False))
    ranges = questions.where(has).select("file_id", F.trim(F.regexp_extract(leak, PASSAGE, 4)).alias("_passage"), F.explode(F.sequence(low, F.greatest(low, high))).alias("number_int"))
    cut = F.when(has, F.transform_values("options", lambda k, v: F.when(k == last, F.regexp_extract(v, PASSAGE, 1)).otherwise(v))).otherwise(F.col("options"))
    first = ranges.groupBy("file_id", "number_int").agg(F.min("_passage").alias("_passage"))
    return questions.withColumn("options", cut).join(first, ["file_id", "number_int"], "left").withColumn("passage", F.coalesce(F.nullif("passage", F.lit("")), "_passage")).drop("_passage").select(questions.columns)


def fill_stems(questions: DataFrame) -> DataFrame:
    """REP-08: empty stems of passage questions get a reference to the blank in the text."""
    text = F.format_string("(見文章第 %s 題空格)", F.col("number"))
    return questions.withColumn("stem", F.when((F.col("type") == "choice") & tx.blank("stem") & ~tx.blank("passage"), text).otherwise(F.col("stem")))


def drop_unusable(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REP-09/FIL-12: (kept, deleted): choice rows with under two options, mostly blank ones, or no
    stem and passage; numbers above 80 without options."""
    values = F.coalesce(F.map_values("options"), F.array().cast("array<string>"))
    blank = F.size(F.filter(values, lambda v: F.coalesce(F.trim(v), F.lit("")) == ""))
    n = F.size(values)
    bad = (F.col("type") == "choice") & ((n < 2) | (blank * 2 > n) | (tx.blank("stem") & tx.blank("passage")) | ((n == 0) & (F.col("number_int") > 80)))
    bad = F.coalesce(bad, F.lit(False))
    return questions.where(~bad), questions.where(bad)


def star_answers(questions: DataFrame) -> DataFrame:
    """REP-10."""
    return questions.withColumn("answer", F.when(F.col("answer").isin("*", "#"), "送分").otherwise(F.col("answer")))


def retype(questions: DataFrame) -> DataFrame:
    """REP-11: essays with int numbers and options are choice; choice rows with under two options are essays."""
    n = F.coalesce(F.size("options"), F.lit(0))
    t = F.when((F.col("type") == "essay") & (F.col("number_kind") == "int") & (n >= 2), "choice").when((F.col("type") == "choice") & (n < 2) & ~tx.blank("stem"), "essay").otherwise(F.col("type"))
    return questions.withColumn("type", t)


def merge_fragments(questions: DataFrame, fragment: Column) -> DataFrame:
    """REP-12: fragments join the question before them."""
    w = Window.partitionBy("file_id").orderBy("pos")
    g = questions.withColumn("_g", F.sum(F.when(fragment, 0).otherwise(1)).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda r: r["stem"]), "\n")
    texts = g.groupBy("file_id", "_g").agg(joined.alias("_stem"))
    return g.where(~fragment).join(texts, ["file_id", "_g"]).withColumn("stem", F.col("_stem")).select(questions.columns)


def complete_metadata(files: DataFrame) -> DataFrame:
    """REP-13: absent facets come from the path."""
    part = lambda i: F.nullif(F.element_at(F.split("path", "/"), i), F.lit(""))
    return files.withColumns(
        {"subject": F.coalesce(F.nullif(F.trim("subject"), F.lit("")), part(-2)), "category": F.coalesce(F.nullif(F.trim("category"), F.lit("")), part(-4)), "exam_time": tx.clean_exam_time("exam_time")}
    )


def annotate(questions: DataFrame) -> DataFrame:
    """REP-14: notes on boxes, short essays and blank options."""
    values = F.coalesce(F.map_values("options"), F.array().cast("array<string>"))
    marks = F.filter(
        F.array(
            F.when(F.contains("stem", F.lit("□")), "box in stem"),
            F.when((F.col("type") == "essay") & (F.length(F.trim("stem")) < 10), "short essay"),
            F.when(F.exists(values, lambda v: F.coalesce(F.trim(v), F.lit("")) == ""), "blank option"),
        ),
        lambda x: x.isNotNull(),
    )
    return questions.withColumn("notes", marks)


def clean_notes(notes: Column) -> Column:
    """REP-17: bare codes, page residue and blanks go."""
    return F.filter(F.transform(notes, lambda n: F.trim(tx.strip_page_residue(n))), lambda n: (n != "") & ~n.rlike(r"^[\d\s\-、]+$"))


def patched(rows: DataFrame, patches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """REP-18: curated values (keys, field, value) over the columns; the last patch of a cell wins."""
    by_cell = patches.groupBy(*keys).pivot("field", columns).agg(F.last("value"))
    return rows.alias("r").join(by_cell.alias("p"), keys, "left").select(
        *[F.coalesce(F.col(f"p.{c}").cast(rows.schema[c].dataType), F.col(f"r.{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns]
    )


def recovered(current: DataFrame, older: DataFrame, keys: list[str]) -> DataFrame:
    """REP-20: questions of an older snapshot that the current one lacks, options split from stems."""
    return split_stem(older.join(current.select(*keys), keys, "left_anti"))


def filled_essays(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """REP-21: essays of a paper's page text (file_id, text) that the paper lacks, behind its questions."""
    from . import parsers

    found = parsers.parse_questions(pages, "file_id").where("type = 'essay'")
    absent = found.join(questions.where("type = 'essay'").select("file_id", "number"), ["file_id", "number"], "left_anti")
    last = questions.groupBy("file_id").agg(F.max("pos").alias("_last"))
    new = absent.join(last, "file_id", "left").withColumn("pos", F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("file_id").orderBy("pos")))
    return questions.unionByName(new.select("file_id", "pos", "number", "type", "stem", "section"), allowMissingColumns=True)


def renamed_brackets(files: DataFrame) -> DataFrame:
    """REP-15: full-width brackets in subjects (paths are rewritten by sinks.write_version)."""
    return files.withColumn("subject", tx.full_width_brackets("subject"))


def clean_texts(questions: DataFrame) -> DataFrame:
    """The text repairs in their order on stem, passage and options, one projection."""
    fix = lambda c: tx.clean_blanks(tx.repair_broken_words(tx.strip_invisible(c)))
    return questions.withColumns({"stem": fix("stem"), "passage": fix("passage"), "options": F.transform_values("options", lambda k, v: fix(v))})
