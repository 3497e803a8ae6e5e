"""Queries that run a stream to its end, in two runs of one checkpoint, and read what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..sources.scratch import shared_folder
from ..streaming import sessions
from .base import query


def _in_two_runs(first: DataFrame, second: DataFrame, name: str, operator) -> DataFrame:
    """What ``operator`` writes for a stream of which the second part arrives after the first run has ended."""
    spark, root = first.sparkSession, shared_folder(first.sparkSession, name)
    for part in (first, second):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{root}/in")
        sessions.to_the_end(operator(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(operator(stream).schema).parquet(f"{root}/out")


@query("""with a as (select user_id, epoch_us(ts) // 1000 at_, event_type, value, event_id from events),
    folded as (select user_id, list_reduce(list_prepend([min(at_)], list_transform(list_sort(list(at_)), lambda x: [x])), lambda acc, x: case when x[1] - acc[len(acc)] < 3600000 then acc else list_concat(acc, x) end) starts from a group by 1),
    placed as (select a.*, list_max(list_filter(starts, lambda s: s <= at_)) started from a join folded using (user_id)),
    firsts as (select *, row_number() over (partition by user_id, started, event_type order by at_, value >= 50) k from placed)
    select cast(user_id as varchar) "user", started, count(*) answers, count(distinct event_type) questions, count(*) filter (where k = 1 and value >= 50) correct
    from firsts where started + 3600000 < (select epoch_us(max(ts)) // 1000 - 7200000 from events) group by 1, 2""")
def streamed_sessions(t):
    """DAT-02, CLI-07: practice sessions of an hour from a stream in two runs, those that have ended for good."""
    e = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") >= 50).alias("right"))
    ends = e.agg(F.unix_millis(F.min("ts")).alias("a"), F.unix_millis(F.max("ts")).alias("b")).first()
    half = F.unix_millis("ts") < ((ends.a or 0) + (ends.b or 0)) // 2
    return _in_two_runs(e.where(half), e.where(~half), "sessions", lambda s: sessions.practice_sessions(s, "ts", "user_id", "event_type", "right"))


@query("select md5(url) key from pages group by 1")
def streamed_requests(t):
    """SNK-13, SRC-16: each address is fetched once, though all are asked for in both runs of the stream."""
    p = t("pages").select(F.md5(F.col("url").cast("binary")).alias("key"), F.timestamp_seconds(1_700_000_000 + F.col("page_id") % 3600).alias("asked"))
    return _in_two_runs(p, p, "requests", lambda s: sessions.first_requests(s, "asked", "key").select("key"))


@query("""select user_id, started, ended, events from (select user_id, min(at_) started, max(at_) + 3600 ended, count(*) events from (select *, sum(new) over (partition by user_id order by at_, event_id rows unbounded preceding) s from
    (select user_id, event_id, epoch_us(ts) // 1000000 at_, case when epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) over (partition by user_id order by ts, event_id) < 3600 then 0 else 1 end new from events)) group by user_id, s)
    where ended <= (select epoch_us(max(ts)) // 1000000 - 7200 from events)""")
def streamed_activity(t):
    """§2.16: runs of a user's events with less than an hour between them, from a stream in two runs, by session windows."""
    e = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    ends = e.agg(F.unix_millis(F.min("ts")).alias("a"), F.unix_millis(F.max("ts")).alias("b")).first()
    half = F.unix_millis("ts") < ((ends.a or 0) + (ends.b or 0)) // 2

    def runs(s: DataFrame) -> DataFrame:
        s = s.withColumn("ts", F.date_trunc("second", "ts")).withWatermark("ts", "2 hours")
        w = s.groupBy(F.session_window("ts", "1 hour"), "user_id").agg(F.count("*").alias("events"))
        return w.select("user_id", F.unix_timestamp("session_window.start").alias("started"), F.unix_timestamp("session_window.end").alias("ended"), "events")

    return _in_two_runs(e.where(half), e.where(~half), "activity", runs)


_RULES = {"capital": r"[A-Z][a-z]+\.", "number": r"[0-9]+", "mark": r"[!?]+"}
_SPANS_SQL = " union all ".join(
    f"""select doc_id, '{k}' as rule, unnest(list_zip(regexp_extract_all(text, '{p}'), list_transform(range(1, len(regexp_extract_all(text, '{p}')) + 1), lambda i: coalesce(list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}')[1:i - 1], lambda x: length(x))), 0)))) z from documents"""
    for k, p in _RULES.items()
)


@query(f"""select doc_id, rule, cast(z[2] as integer) "start", cast(z[2] + length(z[1]) as integer) "end", z[1] "text" from ({_SPANS_SQL})""")
def document_spans(t):
    """TXT-30, DET-05: spans of several patterns from one pass over each whole text."""
    return spans.with_spans(t("documents").select("doc_id", F.col("text").alias("body")), "body", _RULES).drop("body")
