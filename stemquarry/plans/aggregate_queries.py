"""Aggregations (AGG-05..30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import reports as rp
from .base import query

_ISSUES = """(select doc_id, lang, source, case when n_chars < 600 then 'short' when n_chars > 6000 then 'long' else 'plain' end severity,
    case when text like '%@%' then 'at' when text like '%!!%' then 'marks' when text like '%|%' then 'pipe' else 'none' end rule from documents)"""


def issues(t):
    d, text = t("documents"), F.col("text")
    return d.select(
        "doc_id", "lang", "source", F.when(F.col("n_chars") < 600, "short").when(F.col("n_chars") > 6000, "long").otherwise("plain").alias("severity"),
        F.when(F.contains(text, F.lit("@")), "at").when(F.contains(text, F.lit("!!")), "marks").when(F.contains(text, F.lit("|")), "pipe").otherwise("none").alias("rule"),
    )


@query("select source, lang, count(*) n, sum(n_chars) chars, count(*) filter (where n_chars > 2000) n_long from documents group by grouping sets ((source), (lang), ())")
def facet_rollups(t):
    """AGG-05/06."""
    return rp.grouping_sets(t("documents"), [["source"], ["lang"], []], [F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"), F.count_if(F.col("n_chars") > 2000).alias("n_long")])


@query("""select source, count(*) n, 100.0 * count(*) filter (where n_chars > 2000) / count(*) long_pct, 100.0 * count(*) filter (where lang = 'en') / count(*) en_pct
    from documents group by source""")
def group_quality(t):
    """AGG-07/16."""
    return rp.group_quality(t("documents"), "source", {"long_pct": F.col("n_chars") > 2000, "en_pct": F.col("lang") == "en"})


@query("""with g as (select source, avg(n_chars) v from documents group by 1), m as (select avg(v) mm from g where source <> 'src0')
    select source, v, mm mean_of_means, v - mm difference from g, m""")
def mean_of_means(t):
    """AGG-08."""
    return rp.against_mean_of_means(t("documents").groupBy("source").agg(F.avg("n_chars").alias("v")), "source", "v", "src0")


@query(f"""select rule, count(*) filter (where severity = 'short') n_short, count(*) filter (where severity = 'plain') n_plain,
    count(*) filter (where severity = 'long') n_long, count(*) total from {_ISSUES} i group by rule""")
def issue_pivot(t):
    """AGG-09."""
    return rp.pivot_counts(issues(t), "rule", "severity", ["short", "plain", "long"])


@query(f"select rule, severity, count(distinct source) sources, count(*) n from {_ISSUES} i group by all")
def affected_groups(t):
    """AGG-10/19/30."""
    return issues(t).groupBy("rule", "severity").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n"))


@query("select v.rule, coalesce(n, 0) n from (values ('at'), ('marks'), ('pipe'), ('absent')) v(rule) left join (select rule, count(*) n from " + _ISSUES + " i group by 1) g on v.rule = g.rule")
def zero_filled_histogram(t):
    """AGG-11/12."""
    return rp.zero_filled(issues(t), "rule", ["at", "marks", "pipe", "absent"])


@query(f"""select rule, count(distinct source) n, case when count(distinct source) <= 10 then list_sort(list(distinct source)) else list_slice(list_sort(list(distinct source)), 1, 5) end papers
    from {_ISSUES} i group by rule""")
def issues_by_description(t):
    """AGG-13."""
    return rp.by_description(issues(t).select(F.col("rule").alias("detail"), F.col("source").alias("path"))).withColumnRenamed("detail", "rule")


@query(f"select rule, doc_id from {_ISSUES} i qualify row_number() over (partition by rule order by doc_id) <= 30")
def first_examples(t):
    """AGG-14."""
    return rp.first_n(issues(t), ["rule"], ["doc_id"], 30).select("rule", "doc_id")


@query("select k, count(*) n, count(distinct event_type) kinds from (select event_type, unnest(json_keys(props)) k from events) group by k")
def key_profile(t):
    """AGG-15: keys of semi-structured rows."""
    v = t("events").select("event_type", F.explode(F.json_object_keys("props")).alias("k"))
    return v.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("""select source, greatest(0.0, 100 - 100.0 * count(*) filter (where n_chars < 600) / count(*)) score from documents group by 1""")
def quality_scores(t):
    """AGG-17."""
    return t("documents").groupBy("source").agg(rp.quality_score(F.count_if(F.col("n_chars") < 600), F.count("*")).alias("score"))


@query("""select lang, count(*) filter (where s = 'pass') n_pass, count(*) filter (where s = 'fail') n_fail, count(*) filter (where s = 'not_found') n_not_found,
    count(*) filter (where s = 'skip') n_skip, avg(case when s in ('pass', 'fail') then n_chars end) mean_score from
    (select lang, n_chars, case n_chars % 4 when 0 then 'pass' when 1 then 'fail' when 2 then 'not_found' else 'skip' end s from documents) group by lang""")
def similarity_rollup(t):
    """AGG-18."""
    m = F.col("n_chars") % 4
    d = t("documents").select("lang", "n_chars", F.when(m == 0, "pass").when(m == 1, "fail").when(m == 2, "not_found").otherwise("skip").alias("s"))
    return rp.similarity_rollup(d, "lang", "s", "n_chars")


@query("""select source, count(distinct n_chars % 10) as years, min(n_chars % 10) first_year, max(n_chars % 10) last_year, count(*) n from documents group by rollup (source)""")
def coverage(t):
    """AGG-20."""
    return rp.coverage(t("documents").withColumn("y", F.col("n_chars") % 10), "source", "y")


@query("select lang, avg(n) mean from (select lang, source, count(distinct n_chars % 10) n from documents group by 1, 2) group by 1")
def mean_subjects(t):
    """AGG-21."""
    return rp.mean_per(t("documents").withColumn("y", F.col("n_chars") % 10), "lang", "source", "y")


@query("""select source, 100.0 * count(*) filter (where text like 'T%') / count(*) t_pct, count(*) filter (where text like '%(%') half, count(*) filter (where regexp_matches(text, '\\|')) piped
    from documents group by 1""")
def naming_styles(t):
    """AGG-22."""
    x = F.col("text")
    return t("documents").groupBy("source").agg(
        rp.share_of(F.startswith(x, F.lit("T"))).alias("t_pct"), F.count_if(F.contains(x, F.lit("("))).alias("half"), F.count_if(F.contains(x, F.lit("|"))).alias("piped")
    )


@query("""with d as (select conv_id % 20 g, turn y from conversations), a as (select list_sort(list(distinct y)) al from d), o as (select g, list(distinct y) ow from d group by g)
    select g, list_sort(list_filter(al, lambda x: not list_contains(ow, x))) absent from o, a where len(list_filter(al, lambda x: not list_contains(ow, x))) between 1 and 3""")
def absent_in_few(t):
    """AGG-23."""
    return rp.absent_in_few(t("conversations").select((F.col("conv_id") % 20).alias("g"), F.col("turn").alias("y")), "g", "y")


@query("""select lower(w) normal, list_sort(list(distinct w)) spellings from (select unnest(string_split_regex(text, '[^A-Za-z]+')) w from documents) where w <> ''
    group by 1 having count(distinct w) > 1""")
def spellings(t):
    """AGG-24: words with more than one spelling."""
    docs = t("documents").select("text")
    docs = docs.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # one row group up to a million rows
    w = docs.select(F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+"))).alias("w")).where("w <> ''").distinct()
    return rp.spellings(w, "w", F.lower("w"))


@query("select lang, list_sort(list(distinct source)) sources from documents group by 1")
def distinct_lists(t):
    """AGG-25."""
    return t("documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query("select source, list_sort(list(n_chars))[count(*) // 2 + 1] upper_median from documents group by 1")
def upper_median(t):
    """AGG-26."""
    return rp.upper_median(t("documents"), "source", "n_chars")


@query("select event_type, round(sum(value), 6) total, round(avg(value), 9) mean, count(*) n from events group by 1")
def sizes_and_durations(t):
    """AGG-27."""
    return t("events").groupBy("event_type").agg(F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 9).alias("mean"), F.count("*").alias("n"))


@query(f"select source, count(*) n from {_ISSUES} i where rule <> 'none' group by 1 order by n desc, source limit 10")
def top_papers(t):
    """AGG-28."""
    return issues(t).where("rule <> 'none'").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("""select doc_id, len(regexp_extract_all(text, '[A-Za-z]')) / length(text) latin, len(regexp_extract_all(text, '[^A-Za-z0-9\\s]')) / length(text) special from documents where text <> ''""")
def character_shares(t):
    """AGG-29."""
    return t("documents").where("text <> ''").select("doc_id", tx.share("text", "[A-Za-z]").alias("latin"), tx.share("text", r"[^A-Za-z0-9\s]").alias("special"))
