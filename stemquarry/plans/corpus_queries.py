"""Corpus loading, repairs and parsers over papers built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import compare, parsers, repairs, rules, search
from ..sources import corpus, sinks, tables
from .base import query


def papers(t):
    """Conversations as JSON papers: user turns are choice questions with int numbers, others essays."""
    c = t("conversations")
    choice = F.col("role") == "user"
    head = F.format_string('{"number": %s, "type": "%s", "stem": ', F.when(choice, (F.col("turn") + 1).cast("string")).otherwise(F.concat(F.lit('"'), (F.col("turn") + 1).cast("string"), F.lit('"'))), F.when(choice, "choice").otherwise("essay"))
    stem = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    options = F.when(choice, ', "options": {"A": "a", "B": "b", "C": "c", "D": "d"}, "answer": "A"}').otherwise("}")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(head, stem, options).alias("q")))), lambda r: r["q"]), ", ")
    id_ = F.col("conv_id")
    flag = F.when(id_ % 10 == 9, '"_is_duplicate": true, ').otherwise("")
    raw = F.when(id_ % 10 == 8, "{broken").otherwise(F.concat(F.lit("{"), flag, F.lit('"metadata": {"subject": "s"}, "questions": ['), F.col("qs"), F.lit("]}")))
    path = F.format_string("/c/cat%d/%d年/%05d/試題.json", id_ % 5, id_ % 20 + 100, id_)
    return c.groupBy("conv_id").agg(listed.alias("qs")).select(path.alias("path"), raw.alias("raw"))


def typed(t):
    return corpus.parse_papers(papers(t))


@query("select 'cat' || conv_id % 5 category, conv_id % 20 + 100 \"year\", format('{:05d}', conv_id) subject, count(*) questions, count(*) filter (where role = 'user') choice from conversations where conv_id % 10 < 8 group by conv_id")
def loaded_papers(t):
    """SRC-01..06: papers parsed to files and questions, broken and duplicate ones left out."""
    c = typed(t)
    n = c.questions.groupBy("file_id").agg(F.count("*").alias("questions"), F.count_if(F.col("type") == "choice").alias("choice"))
    return c.files.join(n, "file_id").select("category", "year", "subject", "questions", "choice")


@query("select count(distinct conv_id) n, 'not JSON' detail from conversations where conv_id % 10 = 8")
def load_issues(t):
    """SRC-02: broken papers are issue rows."""
    return typed(t).issues.groupBy("detail").agg(F.count("*").alias("n"))


@query("select conv_id % 10000 k, role = 'user' int_number, text stem from conversations where conv_id % 10 < 8")
def question_kinds(t):
    """SRC-02, FIL-08: number kinds survive loading."""
    c = typed(t)
    q = c.questions.join(c.files.select("file_id", "subject"), "file_id")
    return q.select(F.col("subject").cast("long").alias("k"), (F.col("number_kind") == "int").alias("int_number"), "stem")


@query("select format('{:05d}', conv_id) subject from conversations where conv_id % 10 < 8 and conv_id % 5 = 2 and conv_id % 20 + 100 = 102 group by conv_id")
def found_papers(t):
    """SRC-21/22: lookup by facets and an ordered wildcard on the name."""
    return corpus.find_papers(typed(t).files, category="at2", year=102, stem_pattern="試*.json").select("subject")


@query("""select format('{:05d}', conv_id) subject, field, count(*) n from (select conv_id, 'stem' field from conversations where text <> '' union all select conv_id, 'option ' || o from conversations, (values ('A'), ('B'), ('C'), ('D')) v(o) where role = 'user')
    where conv_id % 10 < 8 group by conv_id, field""")
def text_fields(t):
    """PRJ-01/02: every text of a question as rows."""
    c = typed(t)
    f = corpus.text_fields(c.questions, "file_id").join(c.files.select("file_id", "subject"), "file_id")
    return f.groupBy("subject", "field").agg(F.count("*").alias("n"))


@query("select doc_id, substr(text, greatest(1, p - 20), p - greatest(1, p - 20) + 23) snippet from (select doc_id, text, strpos(text, 'the') p from documents) where p > 0")
def snippets(t):
    """PRJ-05."""
    return t("documents").select("doc_id", tx.snippet("text", "the").alias("snippet")).where("snippet is not null")


@query("select conv_id, turn, upper(role) role, upper(replace(text, 'ß', 's')) text from conversations")
def deep_apply(t):
    """PRJ-03: one text function over all text columns."""
    c = t("conversations").withColumn("text", F.replace("text", F.lit("ß"), F.lit("s")))
    return c.withColumns(tx.deep_apply([x for x in c.dtypes if x[1] == "string"], F.upper))


@query("select source, lang from (select distinct source, lang from documents) order by source desc, lang")
def facet_order(t):
    """ORD-08: one facet newest first, the other ascending."""
    return t("documents").select("source", "lang").distinct().orderBy(F.desc("source"), "lang")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn, late) - 1 pos from (select conv_id, turn, 0 late from conversations union all select conv_id, 1, 1 from conversations where turn = 0)")
def inserted_positions(t):
    """ORD-06, JOI-06: a new number goes before the first larger one."""
    from ..operators.windows import Window

    c = t("conversations").select("conv_id", "turn", F.lit(0).alias("late"))
    new = c.where("turn = 0").select("conv_id", F.lit(1).cast("long").alias("turn"), F.lit(1).alias("late"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "late")) - 1
    return c.unionByName(new).select("conv_id", "turn", at.alias("pos"))


@query("""select (select count(distinct conv_id) from conversations where conv_id % 10 < 8) files, count(*) questions, count(*) filter (where role = 'user') choice, count(*) filter (where role <> 'user') essay from conversations where conv_id % 10 < 8""")
def run_stats(t):
    """SNK-09, AGG-01."""
    c = typed(t)
    return sinks.run_stats(c.files, c.questions)


@query("""select format('{:05d}', conv_id) subject, list_sort(list_filter(['1', '2', '3', '4', '5', '6'], lambda x: not list_contains(list(cast(turn + 1 as varchar)), x))) missing from conversations where conv_id % 10 < 8 and conv_id % 5 = 1
    group by conv_id having len(list_filter(['1', '2', '3', '4', '5', '6'], lambda x: not list_contains(list(cast(turn + 1 as varchar)), x))) > 0""")
def missing_tasks(t):
    """DET-20: numbers that a specification expects and papers lack."""
    c = typed(t)
    years = c.files.select("year").distinct()
    specs = years.select(F.lit("cat1").alias("category"), "year", F.lit("").alias("subject"), F.array(*[F.lit(str(i)) for i in range(1, 7)]).alias("expected"))
    return rules.expected_tasks(specs, c.files, c.questions).join(c.files.select("file_id", F.col("subject").alias("name")), "file_id").select(F.col("name").alias("subject"), "missing")


@query("""select format('{:05d}', conv_id) subject, turn + 1 number, string_agg(text, chr(10) order by turn2) stem from (select a.conv_id, a.turn, b.text, b.turn turn2 from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between a.turn and a.turn + 1
    where a.conv_id % 10 < 8 and a.turn % 2 = 0) group by conv_id, turn""")
def merged_fragments_of_papers(t):
    """REP-12: every second question joins the one before it."""
    c = typed(t)
    q = repairs.merge_fragments(c.questions, F.col("pos") % 2 == 1).join(c.files.select("file_id", "subject"), "file_id")
    return q.select("subject", F.col("number").cast("long").alias("number"), "stem")


@query("select count(*) filter (where role <> 'user' and length(trim(text)) < 10) short_essays, count(*) n from conversations where conv_id % 10 < 8")
def annotated(t):
    """REP-14: notes on short essays, boxes and blank options."""
    return repairs.annotate(typed(t).questions).agg(F.count_if(F.array_contains("notes", "short essay")).alias("short_essays"), F.count("*").alias("n"))


@query("select conv_id, list(text order by turn) notes from conversations where text <> '' group by conv_id")
def cleaned_notes(t):
    """REP-17: page residue and bare codes among notes go."""
    n = F.concat(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: F.concat(r["text"], F.lit(" 第 1 頁"))), F.array(F.lit("12345"), F.lit(" ")))
    return t("conversations").groupBy("conv_id").agg(n.alias("notes")).select("conv_id", repairs.clean_notes(F.col("notes")).alias("notes"))


@query("select conv_id, turn from conversations where turn % 3 = 0")
def recovered_questions(t):
    """REP-20, JOI-05: questions of an older snapshot that the current one lacks."""
    q = t("conversations").select("conv_id", "turn", F.lit("choice").alias("type"), F.col("text").alias("stem"), F.lit(None).cast("map<string,string>").alias("options"))
    return repairs.recovered(q.where("turn % 3 <> 0"), q, ["conv_id", "turn"]).select("conv_id", "turn")


@query("select conv_id, cast(turn + 1 as integer) number, translate(text, chr(10), ' ') text from conversations where text <> ''")
def numbered_segments(t):
    """GEN-06/11: text split at question numbers."""
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.translate("text", "\n", " "))
    docs = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda r: r["l"]), "\n").alias("text"))
    out = parsers.numbered_segments(docs, "conv_id")
    return out.select("conv_id", "number", F.regexp_replace("text", r"^\d+\. ", "").alias("text"))


@query("select conv_id, cast(turn + 1 as integer) number, upper(substr('abcd', cast(turn % 4 + 1 as integer), 1)) answer from conversations")
def answer_key_lines(t):
    """GEN-08, SRC-10: number and answer lines."""
    c = t("conversations")
    listed = lambda e: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", e.alias("x")))), lambda r: r["x"]), " ")
    n = c.groupBy("conv_id").agg(listed((F.col("turn") + 1).cast("string")).alias("n"), listed(F.substring(F.lit("abcd"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1))).alias("a"))
    lines = n.select("conv_id", F.posexplode(F.array(F.concat(F.lit("題號 "), "n"), F.concat(F.lit("答案 "), "a"))).alias("line", "text"))
    return parsers.answers_of(lines, "conv_id")


@query("""select user_id doc, cast(event_id % 40 >= 20 as integer) "column", cast(dense_rank() over (partition by user_id, event_id % 40 >= 20 order by event_id // 40) - 1 as integer) line, string_agg(substr(event_type, 1, 1), '' order by event_id % 40) "text"
    from events group by user_id, event_id % 40 >= 20, event_id // 40""")
def two_column_lines(t):
    """GEN-07: characters of a two-column page to lines."""
    e = t("events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 40).cast("double").alias("x"), (F.floor(F.col("event_id") / 40) * 10).cast("double").alias("y"), F.substring("event_type", 1, 1).alias("text"))
    return parsers.two_columns(e, "doc", 20.0)


@query()
def anchored_similarity(t):
    """CMP-04: similarity at the start, else at the stem's first characters."""
    c = t("conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("segment"))
    return c.join(first, "conv_id").select("conv_id", "turn", compare.anchored_similarity("text", "segment").alias("score"))
