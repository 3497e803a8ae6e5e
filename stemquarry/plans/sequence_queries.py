"""Windows, joins and sets (WIN, JOI, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, sets
from ..operators import windows as win
from .base import query

_LINES = "(select l_orderkey p, l_linenumber n from lineitem)"


def lines(t):
    return t("lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_linenumber").alias("n"))


@query(f"select p, n, count(*) occurrences from {_LINES} group by p, n having count(*) > 1")
def number_duplicates(t):
    """WIN-01."""
    return win.duplicates(lines(t), "p", "n")


@query("""select p, list_sort(list_filter(range(lo, hi + 1), lambda x: not list_contains(seen, x))) missing from (select p, min(n) lo, max(n) hi, list(distinct cast(n as bigint)) seen
    from """ + _LINES + """ group by p) where len(list_filter(range(lo, hi + 1), lambda x: not list_contains(seen, x))) > 0""")
def number_gaps(t):
    """WIN-02."""
    return win.missing_numbers(lines(t), "p", "n")


@query(f"""select p, n, before, case when n = before then 'repeat' else 'gap' end kind from (select p, n, lag(n) over (partition by p order by n) before from {_LINES}) where n - before <> 1""")
def adjacent_gaps(t):
    """WIN-03."""
    return win.adjacent_gaps(lines(t), "p", "n")


@query("select conv_id, list(turn order by turn) = range(min(turn), min(turn) + count(*)) continuous from conversations group by conv_id")
def continuous_numbers(t):
    """WIN-04."""
    return win.continuous(t("conversations").withColumn("at", F.col("turn")), "conv_id", "turn", "at")


@query(f"select p, min(n) first_number from {_LINES} group by p having min(n) <> 1")
def late_starts(t):
    """WIN-05."""
    return win.starts_late(lines(t), "p", "n")


@query("""select p, part, case when k = 1 then cast(n as varchar) else n || '-' || k end new_number from (select l_orderkey p, l_linenumber n, l_partkey part,
    row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) k from lineitem)""")
def suffixed_repeats(t):
    """WIN-06."""
    x = t("lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), "l_suppkey", "l_extendedprice", "l_shipdate")
    return win.suffix_repeats(x, "p", "n", "part", "l_suppkey", "l_extendedprice", "l_shipdate").select("p", "part", "new_number")


@query("select conv_id, role, turn, text from conversations qualify row_number() over (partition by conv_id, role order by length(text) desc, turn) = 1")
def keep_longest(t):
    """WIN-07."""
    return win.keep_longest(t("conversations"), ["conv_id", "role"], "text", "turn")


@query("""select conv_id, min(turn) "first", max(turn) "last", count(*) n from (select conv_id, turn, turn - row_number() over (partition by conv_id order by turn) g from conversations where length(text) > 150)
    group by conv_id, g""")
def islands(t):
    """WIN-09."""
    return win.islands(t("conversations"), "conv_id", "turn", F.length("text") > 150)


@query("select p, n, coalesce(lead(n) over (partition by p order by n), 99) segment_end from (select distinct p, n from " + _LINES + ")")
def segment_ends(t):
    """WIN-10."""
    return win.segment_end(lines(t).distinct(), "p", "n", F.lit(99))


@query("""select conv_id, turn, last_value(case when role = 'user' then substr(text, 1, 20) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) section
    from conversations""")
def carried_section(t):
    """WIN-11/12."""
    c = t("conversations")
    return c.select("conv_id", "turn", win.carried("conv_id", "turn", F.when(F.col("role") == "user", F.substring("text", 1, 20))).alias("section"))


@query("""select conv_id, segment, min(turn) turn, string_agg(text, chr(10) order by turn) text from (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) segment from conversations)
    where segment > 0 group by 1, 2""")
def attached_lines(t):
    """WIN-13."""
    return win.attach_lines(t("conversations"), "conv_id", "turn", "text", F.col("role") == "user")


@query("""select u, ev, sum(case when step > 0.5 then 1 else 0 end) over (partition by u order by v) line from
    (select user_id u, event_id ev, value v, value - lag(value) over (partition by user_id order by value) step from events)""")
def lines_by_gap(t):
    """WIN-14."""
    e = t("events").select(F.col("user_id").alias("u"), F.col("event_id").alias("ev"), F.col("value").alias("v"))
    return win.lines_by_gap(e, "u", "v", 0.5).select("u", "ev", "line")


@query("""with g as (select user_id u, event_id e, value v, value - lag(value) over (partition by user_id order by value) gap from events),
    m as (select u, list_sort(list(gap))[count(gap) // 2 + 1] md from g where gap is not null group by u)
    select g.u, e, sum(case when gap > greatest(1.5 * md, 3.0) then 1 else 0 end) over (partition by g.u order by v) paragraph from g left join m on g.u = m.u""")
def paragraphs_by_gap(t):
    """WIN-15."""
    e = t("events").select(F.col("user_id").alias("u"), F.col("event_id").alias("e"), F.col("value").alias("v"))
    return win.paragraph_id(e, "u", "v", 1.5, 3.0).select("u", "e", "paragraph")


@query("""select conv_id, turn, sum(f) over (partition by conv_id order by turn rows between 2 preceding and 2 following) - f near from (select *, case when role = 'user' then 1 else 0 end f from conversations)""")
def neighbour_counts(t):
    """WIN-16."""
    return t("conversations").select("conv_id", "turn", win.neighbours("conv_id", "turn", F.col("role") == "user").alias("near"))


@query("select text, conv_id, turn from conversations qualify row_number() over (partition by text order by conv_id, turn) = 1")
def first_seen(t):
    """WIN-17/19."""
    return win.first_seen(t("conversations").select("text", "conv_id", "turn"), ["text"], "conv_id", "turn")


@query("""select conv_id, turn, coalesce(role <> lag(role) over (partition by conv_id order by turn), true) changed from conversations""")
def changed_section(t):
    """WIN-17."""
    return t("conversations").select("conv_id", "turn", win.changes("conv_id", "turn", "role").alias("changed"))


@query("""select conv_id, max(turn) filter (where role = 'user') last_early, min(turn) filter (where role = 'assistant') first_late from conversations group by 1
    having max(turn) filter (where role = 'user') > min(turn) filter (where role = 'assistant')""")
def order_violations(t):
    """WIN-18."""
    return win.order_violations(t("conversations"), "conv_id", "turn", F.col("role") == "assistant", F.col("role") == "user")


@query("""select conv_id, turn, case when k <= 10 then substr('一二三四五六七八九十', k, 1) else cast(k as varchar) end numeral from
    (select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) as integer) k from conversations)""")
def numerals(t):
    """WIN-20."""
    c = t("conversations")
    at = F.row_number().over(win.Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("k", at).select("conv_id", "turn", win.numeral_of(F.col("k")).alias("numeral"))


@query("""select conv_id, turn, last_value(case when role = 'assistant' then text end ignore nulls) over (partition by conv_id order by turn range between 9 preceding and 1 preceding) passage from conversations""")
def asof_passage(t):
    """JOI-12."""
    c = t("conversations").withColumn("v", F.when(F.col("role") == "assistant", F.col("text")))
    return c.select("conv_id", "turn", win.as_of_within("conv_id", "turn", "v").alias("passage"))


@query("select d.doc_id, coalesce(cast(l.quality as varchar), 'none') answer from documents d left join labels l on d.doc_id = l.doc_id")
def fill_from_key(t):
    """JOI-02."""
    rows = t("documents").select("doc_id", F.lit(None).cast("string").alias("answer"))
    key = t("labels").select("doc_id", F.col("quality").cast("string").alias("answer"))
    return joins.fill_from_key(rows, key, ["doc_id"], "answer").fillna("none", ["answer"])


@query("select d.doc_id, coalesce(cast(l.quality as varchar), d.lang) answer from documents d left join labels l on d.doc_id = l.doc_id")
def overwrite_from_key(t):
    """JOI-03/10."""
    key = t("labels").select("doc_id", F.col("quality").cast("string").alias("answer"))
    return joins.fill_from_key(t("documents").select("doc_id", F.col("lang").alias("answer")), key, ["doc_id"], "answer", overwrite=True)


@query("""select doc_id, coalesce(case when toxic = 1 then 'toxic' end, case when quality = 1 then 'good' end, lang) answer from (select d.doc_id, lang, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id)
    where coalesce(case when toxic = 1 then 'toxic' end, case when quality = 1 then 'good' end, lang) is not null""")
def overlay_priority(t):
    """JOI-04."""
    lab = t("labels")
    base = t("documents").select("doc_id", F.col("lang").alias("answer"))
    fixes = lab.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("#").alias("answer"))
    notes = lab.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("answer"))
    return joins.overlay([base, fixes, notes], ["doc_id"], "answer")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def key_missing(t):
    """JOI-05."""
    return joins.missing_from(t("documents").select("doc_id"), t("labels"), ["doc_id"])


@query("select doc_id, quality from labels union all select doc_id, -1 from documents where doc_id not in (select doc_id from labels)")
def insert_absent(t):
    """JOI-06."""
    return joins.insert_absent(t("labels").select("doc_id", "quality"), t("documents").select("doc_id", F.lit(-1).alias("quality")), ["doc_id"])


@query("""select a.c_nationkey, a.c_mktsegment segment_a, b.c_mktsegment segment_b, a.n n_a, b.n n_b from (select c_nationkey, c_mktsegment, count(*) n from customer group by 1, 2) a
    join (select c_nationkey, c_mktsegment, count(*) n from customer group by 1, 2) b on a.c_nationkey = b.c_nationkey and a.c_mktsegment < b.c_mktsegment""")
def pairs_within(t):
    """JOI-07: pairs of segments within a nation (a fixed handful per group)."""
    g = t("customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return joins.pairs_within(g, ["c_nationkey"], "segment")


@query("""select c.conv_id, c.turn, r.lo from conversations c join (select conv_id, turn lo, turn + 2 hi from conversations where role = 'user') r on c.conv_id = r.conv_id and c.turn between r.lo and r.hi""")
def range_spread(t):
    """JOI-08."""
    c = t("conversations")
    ranges = c.where("role = 'user'").select("conv_id", F.col("turn").alias("lo"), (F.col("turn") + 2).alias("hi"))
    return joins.spread_ranges(ranges, c.select("conv_id", "turn"), "conv_id", "lo", "hi", "turn").select("conv_id", "turn", "lo")


@query("""select d.doc_id, case when d.n_chars < 1000 and l.quality is not null then l.quality else -1 end quality from documents d left join labels l on d.doc_id = l.doc_id""")
def from_reference(t):
    """JOI-09."""
    rows = t("documents").select("doc_id", "n_chars", F.lit(-1).alias("quality"))
    return joins.with_reference(rows, t("labels"), ["doc_id"], ["quality"], F.col("n_chars") < 1000).select("doc_id", "quality")


@query("""select o_custkey, s, shared from (select o.o_custkey, x.s, count(*) shared, row_number() over (partition by o.o_custkey order by count(*) desc, x.s) k from
    (select distinct o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey) o join (select distinct l_suppkey s, l_partkey from lineitem) x on o.l_partkey = x.l_partkey group by 1, 2) where k = 1""")
def best_match(t):
    """JOI-11."""
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    left = t("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")
    right = li.select(F.col("l_suppkey").alias("s"), F.col("l_suppkey").alias("o"), "l_partkey")
    return joins.best_match(left, right, "o_custkey", "s", ["l_partkey"], "o")


@query("select d.doc_id, d.lang left_value, cast(l.quality as varchar) right_value from documents d left join labels l on d.doc_id = l.doc_id")
def side_by_side(t):
    """JOI-13."""
    right = t("labels").select("doc_id", F.col("quality").cast("string").alias("v"))
    return joins.side_by_side(t("documents").select("doc_id", F.col("lang").alias("v")), right, ["doc_id"], "v", keep_missing=True)


@query("select c.conv_id, c.turn from conversations c join (select conv_id, substr(text, 1, 12) p from conversations where turn = 0) h on c.conv_id = h.conv_id where contains(c.text, h.p)")
def contained_phrases(t):
    """JOI-14."""
    c = t("conversations")
    heads = c.where("turn = 0").select("conv_id", F.substring("text", 1, 12).alias("p"))
    return joins.contained(heads, c.select("conv_id", "turn", "text"), "conv_id", "p", "text").select("conv_id", "turn")


@query("""select w, count(*) n from (select unnest(string_split_regex(text, '[^a-z]+')) w from conversations) where w <> '' and w in (select unnest(string_split_regex(text, '[^a-z]+')) from benchmark) group by w""")
def known_words(t):
    """JOI-15."""
    split = lambda df: df.select(F.explode(F.split("text", "[^a-z]+")).alias("w")).where("w <> ''")
    return joins.known_words(split(t("conversations")), split(t("benchmark")), "w", "w").groupBy("w").agg(F.count("*").alias("n"))


@query("""select coalesce(a.k, b.k) k, a.k is not null in_left, b.k is not null in_right from (select distinct doc_id k from documents) a full join (select distinct vec_id * 3 k from embeddings) b on a.k = b.k""")
def presence_both_ways(t):
    """JOI-16."""
    return joins.presence(t("documents").select(F.col("doc_id").alias("k")), t("embeddings").select((F.col("vec_id") * 3).alias("k")), "k")


@query("""with k as (select distinct conv_id, substr(text, 1, 8) f from conversations), s as (select conv_id, count(*) n from k group by 1)
    select a.conv_id a, b.conv_id b, count(*) common, any_value(s.n) n_left, any_value(r.n) n_right, count(*) / greatest(any_value(s.n), any_value(r.n)) of_max, count(*) / least(any_value(s.n), any_value(r.n)) of_min,
    case when count(*) / least(any_value(s.n), any_value(r.n)) > 0.8 then 'same' when count(*) / least(any_value(s.n), any_value(r.n)) > 0.2 then 'partial' else 'different' end kind
    from k a join k b on a.f = b.f and a.conv_id < b.conv_id join s on a.conv_id = s.conv_id join s r on b.conv_id = r.conv_id group by 1, 2""")
def fingerprint_overlap(t):
    """SET-01/02: shared stem prefixes of two papers."""
    k = t("conversations").select("conv_id", F.substring("text", 1, 8).alias("f"))
    out = sets.overlap(k.withColumnRenamed("conv_id", "a"), k.withColumnRenamed("conv_id", "b"), "a", "b", "f", once=True)
    return out.withColumn("kind", sets.overlap_class(F.col("of_min")))


@query("""with a as (select lang, list(distinct source) s from documents where n_chars > 3000 group by 1), b as (select lang, list(distinct source) s from documents where n_chars <= 700 group by 1)
    select a.lang, list_sort(list_filter(a.s, lambda x: not list_contains(b.s, x))) missing, list_sort(list_filter(b.s, lambda x: not list_contains(a.s, x))) extra from a join b on a.lang = b.lang""")
def key_difference(t):
    """SET-03/04."""
    d = t("documents")
    a = d.where("n_chars > 3000").groupBy("lang").agg(F.collect_set("source").alias("sa"))
    b = d.where("n_chars <= 700").groupBy("lang").agg(F.collect_set("source").alias("sb"))
    return a.join(b, "lang").select("lang", sets.key_difference(F.col("sa"), F.col("sb")).alias("d")).select("lang", "d.missing", "d.extra")


@query("select distinct lang, source, n_chars from documents")
def distinct_issues(t):
    """SET-05."""
    return sets.distinct_issues(t("documents").select(F.col("lang").alias("rule"), F.col("source").alias("path"), F.col("n_chars").alias("number"))).toDF("lang", "source", "n_chars")


@query("select doc_id, min(doc_id) over (partition by md5(text)) copy_of, doc_id <> min(doc_id) over (partition by md5(text)) is_copy from documents")
def array_identity(t):
    """SET-07, REP-19."""
    return sets.flag_copies(t("documents").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "copy_of", "is_copy")
