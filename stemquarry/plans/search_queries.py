"""Search, statistics and sampling queries (FIL, ORD, AGG-01..04, JOI-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, search
from ..sources import sinks
from .base import doc_files, doc_questions, query, questions

_FILES = "(select doc_id file_id, source category, cast(n_chars % 10 + 100 as integer) \"year\", lang subject from documents)"
_QUESTIONS = "(select d.doc_id file_id, cast(d.doc_id as varchar) number, lang type, text stem, coalesce(cast(quality as varchar), '') answer from documents d left join labels l on d.doc_id = l.doc_id)"


@query(
    f"""select q.file_id, q.number, q.type, f.category, f."year" from {_QUESTIONS} q join {_FILES} f on q.file_id = f.file_id
    where q.stem ilike '%thing%' order by f."year" desc, f.category, q.number, q.file_id limit 100"""
)
def keyword_search(t):
    """FIL-05, JOI-01, ORD-01: keyword over texts, joined to facets, ordered and limited."""
    found = search.search(doc_questions(t), doc_files(t), "thing", qtype=None, limit=100, text_columns=("stem",))
    return found.select("file_id", "number", "type", "category", "year")


@query(
    f"""select q.file_id, q.number, f.category, f."year", f.subject, q.answer from {_QUESTIONS} q join {_FILES} f on q.file_id = f.file_id
    where q.type = 'en' and f."year" = 103 and f.category ilike '%SRC1%' and f.subject ilike '%E%' and q.answer = '1'"""
)
def facet_search(t):
    """FIL-01..04, 06: all facets at once, no limit."""
    found = search.search(doc_questions(t), doc_files(t), year=103, category="SRC1", subject="E", answer="1", qtype="en", limit=None)
    return found.select("file_id", "number", "category", "year", "subject", "answer")


@query(f"""select q.file_id, f."year", q.number from {_QUESTIONS} q join {_FILES} f on q.file_id = f.file_id where q.type = 'de'
    order by f."year" desc, f.category, cast(q.number as integer), q.file_id limit 50""")
def search_numeric_order(t):
    """ORD-01 with numbers as numbers."""
    return search.search(doc_questions(t), doc_files(t), qtype="de", limit=50, numeric_order=True).select("file_id", "year", "number")


@query("select doc_id from documents where contains(text, '%') or contains(text, '_')")
def search_literal_wildcards(t):
    """FIL-05: % and _ in a keyword are literal by default."""
    return t("documents").where(search.keyword("%", ("text",)) | search.keyword("_", ("text",))).select("doc_id")


@query("""select (select count(*) from (select distinct conv_id from conversations)) files, count(*) questions, count(*) filter (where role = 'user') choice,
    count(*) filter (where role = 'assistant') essay from conversations""")
def stats_totals(t):
    """AGG-01."""
    kind = F.when(F.col("type") == "user", "choice").when(F.col("type") == "assistant", "essay").otherwise("other")
    q = questions(t).withColumn("type", kind)
    return search.totals(q.select("file_id").distinct(), q)


@query("select n_chars % 10 + 100 \"year\", count(*) n from documents group by 1")
def stats_by_year(t):
    """AGG-02."""
    return search.counts(t("documents").select((F.col("n_chars") % 10 + 100).alias("year")), "year")


@query("select source category, count(*) n from documents group by 1 order by n desc, category")
def stats_by_category(t):
    """AGG-03."""
    return search.counts(t("documents").select(F.col("source").alias("category")), "category").orderBy(F.desc("n"), "category")


@query(f"select answer, count(*) n from {_QUESTIONS} q where type = 'en' group by 1")
def answer_distribution(t):
    """AGG-04."""
    return search.counts(doc_questions(t).where("type = 'en'"), "answer")


@query("select case when role = 'user' then 'choice' when role = 'assistant' then 'essay' else 'other' end kind, count(*) n from conversations group by 1")
def type_split(t):
    """FIL-07."""
    return search.counts(questions(t).select(F.when(F.col("type") == "user", "choice").when(F.col("type") == "assistant", "essay").otherwise("other").alias("kind")), "kind")


@query("select doc_id, text from documents where text similar to '(.|\\n)*(number|order) [0-9]+(.|\\n)*' or regexp_matches(text, '[0-9]{16}')")
def figure_references(t):
    """FIL-11: texts that match a reference pattern."""
    return t("documents").where(F.col("text").rlike(r"(number|order) [0-9]+") | F.col("text").rlike("[0-9]{16}")).select("doc_id", "text")


@query("select conv_id, try_cast(text as integer) is not null numeric_text, count(*) n from conversations group by 1, 2")
def numeric_kind(t):
    """FIL-08: rows whose text is a number, by attempt."""
    return t("conversations").groupBy("conv_id", F.col("text").try_cast("int").isNotNull().alias("numeric_text")).agg(F.count("*").alias("n"))


@query("""with o as (select lang, least(count(*), 25) own, count(*) - least(count(*), 25) rest from documents group by 1),
    f as (select own + greatest(0, least(rest, 100 - sum(own) over () - coalesce(sum(rest) over (order by lang rows between unbounded preceding and 1 preceding), 0))) n from o)
    select min(n) least, max(n) most, sum(n) total from f""")
def stratified_sample_sizes(t):
    """ORD-03: sizes of a sample of 100 over four languages."""
    s = search.stratified_sample(t("documents").select("doc_id", "lang"), "lang", 100, "doc_id")
    return s.groupBy("lang").count().agg(F.min("count").alias("least"), F.max("count").alias("most"), F.sum("count").alias("total"))


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by case when role = 'assistant' then 0 else 1 end, turn) <= 3")
def essays_first(t):
    """ORD-05: one type first, then by number; the first three of each paper."""
    q = t("conversations").withColumn("late", (F.col("role") != "assistant").cast("int"))
    return reports.first_n(q, ["conv_id"], ["late", "turn"], 3).select("conv_id", "turn", "role")


@query("select conv_id, turn, '[' || turn || '] ' || text formatted from conversations")
def formatted_questions(t):
    """SNK-12."""
    return sinks.formatted(questions(t)).select(F.col("file_id").alias("conv_id"), F.col("pos").alias("turn"), "formatted")


@query("select row_number() over (order by url, page_id) file_id, page_id, url, length(html) n_chars from pages")
def surrogate_ids(t):
    """SNK-01: dense ids in order without one global window over the rows."""
    from ..sources import corpus

    return corpus.dense_ids(t("pages").select("html", "url", "page_id"), "file_id", "url", "page_id").select("file_id", "page_id", "url", F.length("html").alias("n_chars"))
