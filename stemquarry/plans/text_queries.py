"""Text functions, rule detectors, parsers, comparison, pages and client operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..operators import client, compare, dictionary, parsers, repairs, rules
from ..sources import pages as pg
from ..sources import tables
from .base import query
from .fixtures import quoted


@query("select doc_id, regexp_replace(lower(translate(text, '，。；：？！（）', ',.;:?!()')), '\\s+', '', 'g') k from documents")
def comparison_keys(t):
    """TXT-04."""
    return t("documents").select("doc_id", tx.comparison_key("text").alias("k"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) k from documents")
def loose_keys(t):
    """TXT-05."""
    return t("documents").select("doc_id", tx.loose_key("text").alias("k"))


@query("select doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') clean from documents")
def control_characters(t):
    """TXT-08."""
    return t("documents").select("doc_id", tx.strip_invisible("text").alias("clean"))


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g')) clean from documents")
def blank_cleanup(t):
    """TXT-10/11."""
    return t("documents").select("doc_id", tx.clean_blanks("text").alias("clean"))


@query("select doc_id, regexp_replace(regexp_replace(text, '(\\d)([A-Za-z]{2,})', '\\1 \\2', 'g'), '([A-Za-z]{2,})(\\d)', '\\1 \\2', 'g') spaced from documents")
def digit_spacing(t):
    """TXT-17."""
    return t("documents").select("doc_id", tx.space_digits("text").alias("spaced"))


@query("select doc_id, regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g') split, len(regexp_extract_all(text, '[a-z][A-Z]')) hits from documents")
def camel_split(t):
    """TXT-16."""
    return t("documents").select("doc_id", tx.split_camel("text").alias("split"), F.regexp_count("text", F.lit("[a-z][A-Z]")).cast("long").alias("hits"))


@query("""select page_id, substr(trim(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', ' ', 'g')), 1, 80) name from pages""")
def file_names(t):
    """TXT-29."""
    return t("pages").select("page_id", tx.safe_file_name("url").alias("name"))


@query("""select item_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') html from benchmark""")
def escaped_html(t):
    """TXT-31."""
    return t("benchmark").select("item_id", tx.escape_html("text").alias("html"))


@query("select doc_id, substr(md5(text), 1, 8) h, 'y' || (n_chars % 10 + 100) || '-' || source card from documents")
def hash_ids(t):
    """MTH-01, PRJ-04."""
    return t("documents").select("doc_id", tx.hash_prefix("text").alias("h"), tx.card_id((F.col("n_chars") % 10 + 100), "source").alias("card"))


@query("select user_id, cast(floor(100.0 * count(*) filter (where event_type = 'error') / count(*) + 0.5) as bigint) pct from events group by 1")
def rounded_percent(t):
    """MTH-02."""
    g = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("n"))
    return g.select("user_id", tx.percent("e", "n").alias("pct"))


@query("select o_orderkey, year(o_orderdate) - 1911 minguo, year(o_orderdate) gregorian, range(100, 100 + o_orderkey % 4 + 1) as years from orders")
def minguo_years(t):
    """DAT-01."""
    y = F.year("o_orderdate") - 1911
    span = tx.year_list(F.concat(F.lit("100-"), (100 + F.col("o_orderkey") % 4).cast("string")))
    return t("orders").select("o_orderkey", y.cast("long").alias("minguo"), tx.gregorian(y).cast("long").alias("gregorian"), F.transform(span, lambda v: v.cast("long")).alias("years"))


@query("select doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 n from documents")
def marker_counts(t):
    """JSN-01."""
    return t("documents").select("doc_id", tx.marker_count("text", "the").alias("n"))


@query("""select p.doc_id, case when p.doc_id % 7 = 0 then 'patched' else lang end lang from documents p""")
def patched_values(t):
    """REP-18: a patch table over a column."""
    d = t("documents")
    patches = d.where("doc_id % 7 = 0").select("doc_id", F.lit("lang").alias("field"), F.lit("patched").alias("value"))
    return repairs.patched(d.select("doc_id", "lang"), patches, ["doc_id"], ["lang"])


@query("""select doc_id, line, case when regexp_matches(trim(text), '^-?\\d+-?$') or trim(text) = '' then 'header' when regexp_matches(trim(text), '^\\s*(\\d{1,3})\\s*[.、．)\\s]\\s*(.+)') then 'choice' else 'other' end kind
    from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 line, unnest(string_split(text, chr(10))) text from documents)""")
def line_kinds(t):
    """FIL-10, GEN-02: kinds of text lines."""
    x = parsers.lines_of(t("documents"), "doc_id")
    kind = F.when(parsers.is_header(F.col("text")), "header").when(F.col("text").rlike(parsers.CHOICE), "choice").otherwise("other")
    return x.select("doc_id", F.col("line").cast("long").alias("line"), kind.alias("kind"))


@query("select doc_id, case when lang in ('de', 'fr') then 'north' when source = 'src0' then 'first' end category from documents")
def category_rules(t):
    """GEN-10: first matching rule over joined names."""
    return t("documents").select("doc_id", parsers.category_of(F.array("lang", "source"), [("north", r"^(?:de|fr)\|"), ("first", r"\|src0$")]).alias("category"))


@query()
def norm_compare(t):
    """CMP-01/03/07: similarity of each turn with the same turn of the next conversation."""
    c = t("conversations").select("conv_id", "turn", "text")
    return compare.question_similarity(c, c.withColumn("conv_id", F.col("conv_id") - 1), ["conv_id", "turn"]).select("conv_id", "turn", "score", "status")


@query()
def edit_steps(t):
    """CMP-02: edits between neighbouring turns of a conversation."""
    from ..operators.windows import Window

    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t("conversations").withColumn("before", prev).where("before is not null")
    return c.select("conv_id", "turn", F.size(compare.edits("before", "text")).alias("n"))


@query("""select conv_id, turn, (length(text) >= 30 and contains(f, substr(text, 1, 30))) or (length(text) >= 15 and contains(f, substr(text, 1, 15))) or (length(text) >= 10 and contains(f, substr(text, 1, 10))) covered
    from (select c.*, first_value(text) over (partition by conv_id order by turn) f from conversations c)""")
def fingerprint_coverage(t):
    """CMP-06."""
    c = t("conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("f"))
    return compare.fingerprint_coverage(c, first, "conv_id", "text", "f").select("conv_id", "turn", "covered")


@query("""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, len(regexp_extract_all(html, '<p[ >]')) n_p, len(regexp_extract_all(html, '<a[ >]')) n_a,
    len(regexp_extract_all(html, '<script[ >]')) n_script, len(regexp_extract_all(html, 'href="([^"]*)"')) n_links, length(html) n_chars from pages""")
def html_counts(t):
    """SRC-13, DET-16."""
    return pg.page_counts(t("pages"))


@query("""select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href from pages""")
def html_links(t):
    """SRC-13/15."""
    return t("pages").select("page_id", F.explode(pg.links(F.col("html"))).alias("href"))


_ENTITIES = {"quot": '"', "middot": "·", "copy": "©", "lt": "<", "gt": ">", "nbsp": "\u00a0", "#39": "\x27", "amp": "&"}
_BARE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?i)<(?:p|div|li|br|h1|h2|h3|article|footer|nav)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"""


@query(f"""select page_id, regexp_replace(regexp_replace(x, '\\n{{2,}}', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') "text" from (select page_id, {"".join("replace(" for _ in _ENTITIES)}{_BARE_SQL}{"".join(f", '&{k};', {quoted(v)})" for k, v in _ENTITIES.items())} x from pages)""")
def html_text(t):
    """SRC-12: visible text."""
    return t("pages").select("page_id", udfs.visible_text("html").alias("text"))


@query("select md5(url || ':' || page_id) key, page_id from pages where page_id % 3 <> 0")
def uncached_downloads(t):
    """SRC-16."""
    wanted = t("pages").select("url", F.col("page_id").cast("string").alias("path"), "page_id")
    cache = wanted.where("page_id % 3 = 0").select(F.md5(F.concat_ws(":", "url", "path").cast("binary")).alias("key"))
    return tables.uncached(wanted, cache).select("key", "page_id")


@query("select doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 hits from documents where contains(lower(text), 'the')")
def occurrence_counts(t):
    """CLI-01/02."""
    return client.card_search(t("documents"), "text", query="The", key="doc_id").select("doc_id", "hits")


@query("select source, list_sort(list(distinct lang), 'DESC') as years, count(*) cards from documents group by 1")
def subject_view(t):
    """CLI-04."""
    return client.subject_view(t("documents"), "source", "lang")


@query("select doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 hits from documents where contains(lower(text), 'the') and doc_id in (select doc_id from labels where quality = 1)")
def bookmarked_search(t):
    """CLI-05/06."""
    return client.card_search(t("documents"), "text", query="the", bookmarks=t("labels").where("quality = 1"), key="doc_id").select("doc_id", "hits")


@query("""with f as (select user_id, event_type, min_by(event_id % 4, event_id) p, min_by(event_id % 3, event_id) r from events group by 1, 2)
    select user_id, count(*) filter (where p = r) correct, count(*) total, cast(floor(100.0 * count(*) filter (where p = r) / count(*) + 0.5) as bigint) pct from f group by 1""")
def practice_score(t):
    """CLI-07."""
    e = t("events").select("user_id", "event_type", "event_id", (F.col("event_id") % 4).alias("p"), (F.col("event_id") % 3).alias("r"))
    return client.practice_score(e, "user_id", "event_type", "event_id", "p", "r")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 20")
def practice_history(t):
    """CLI-08."""
    return client.history(t("events").select("user_id", "event_id"), "user_id", "event_id")


@query("""select p_partkey, p_name || '（' || array_to_string(case when p_size % 6 > 4 then [p_brand, p_type] else list_slice([p_brand, p_type, p_brand, p_type, p_brand, p_type], 1, p_size % 6 + 1) end, '、') || case when p_size % 6 > 4 then '等' else '' end || '）' subject from part where p_size % 6 <> 4
    union all select p_partkey, p_name || '（' || p_brand || '、' || p_type || '等）' from part where p_size % 6 = 4""")
def shortened_subjects(t):
    """TXT-28: more than four listed names keep two (six are listed where the size leaves 5, five where it leaves 4)."""
    p = t("part")
    names = F.slice(F.array("p_brand", "p_type", "p_brand", "p_type", "p_brand", "p_type"), F.lit(1), F.col("p_size") % 6 + 1)
    return p.select("p_partkey", tx.shorten_subject(F.concat("p_name", F.lit("（"), F.array_join(names, "、"), F.lit("）"))).alias("subject"))


def _reference_words(t, least: int):
    words = t("benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query()
def segmented_words(t):
    """TXT-18..20, SRC-18: glued words split by a frequency dictionary of all words of the reference texts."""
    glued = t("benchmark").select("item_id", F.regexp_replace("text", "([a-z]) ([a-z])", "$1$2").alias("text"))
    return dictionary.split_words(glued, "item_id", "text", _reference_words(t, 2))


@query()
def merged_fragments(t):
    """TXT-22/23: fragments joined into known words."""
    broken = t("benchmark").select("item_id", F.regexp_replace("text", "([a-z]{2})([a-z]{3})", "$1 $2").alias("text"))
    return dictionary.join_fragments(broken, "item_id", "text", _reference_words(t, 5))


@query("select conv_id, turn, 'text' field, text before, text || '!' after from conversations where turn % 2 = 0")
def change_log(t):
    """SNK-03/05: changed cells with their values before and after."""
    from ..sources import sinks

    c = t("conversations").select("conv_id", "turn", "role", "text")
    new = c.withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return sinks.change_log(c, new, ["conv_id", "turn"], ["role", "text"])
