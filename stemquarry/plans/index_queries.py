"""Queries over the keyword index and over containment without a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import grams
from ..sources import layout
from ..sources.scratch import shared_folder
from .base import doc_files, doc_questions, query
from .fixtures import quoted

#: Keywords of two characters and more, of one (which has no gram), with a wildcard, in another case, and one that is nowhere.
_KEYWORDS = [("thing", False), ("GNU general", False), ("ón", False), ("x", False), ("tion%.", True), ("%", False), ("qqqqq", False), ("license", False)]
_LIKE = {("tion%.", True): "%tion%.%", ("%", False): "%\\%%"}


def _index(t) -> grams.KeywordIndex:
    rows = doc_questions(t).select("file_id", "pos", "number", "type", "stem", "answer")
    return grams.write_index(rows, shared_folder(rows.sparkSession, "index"), "file_id", ("stem",))


@query(" union all ".join(f"select {quoted(k)} keyword, doc_id file_id from documents where text ilike {quoted(_LIKE.get((k, w), f'%{k}%'))} escape '\\'" for k, w in _KEYWORDS))
def indexed_keywords(t):
    """FIL-05: rows of each keyword by the index, the same as a scan's."""
    index = _index(t)
    out = None
    for k, w in _KEYWORDS:
        one = grams.indexed_rows(index, k, w).select(F.lit(k).alias("keyword"), "file_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select file_id, number, type, category, "year", substr(text, greatest(1, at_ - 20), at_ - greatest(1, at_ - 20) + 27) snippet from
    (select doc_id file_id, cast(doc_id as varchar) number, lang type, source category, cast(n_chars % 10 + 100 as integer) "year", text, position('license' in text) at_ from documents
    where text ilike '%license%' order by "year" desc, category, number, file_id limit 100) where at_ > 0""")
def indexed_search(t):
    """FIL-05, JOI-01, ORD-01, PRJ-05: a keyword by the index, joined to facets, ordered and limited, with its surroundings."""
    found = grams.indexed_search(_index(t), doc_files(t), "license", qtype=None, limit=100)
    return found.where(F.contains("stem", F.lit("license"))).select("file_id", "number", "type", "category", "year", tx.snippet("stem", "license").alias("snippet"))


_PIECES = "select item_id, trim(unnest(string_split_regex(text, '[.!?]'))) piece from benchmark"


@query(f"select b.item_id, b.piece, d.doc_id from (select distinct item_id, piece from ({_PIECES}) where piece <> '') b join documents d on contains(d.text, b.piece)")
def phrases_anywhere(t):
    """JOI-14, CMP-05: every sentence of the reference texts in every document that holds it."""
    pieces = t("benchmark").select("item_id", F.explode(F.split("text", "[.!?]")).alias("piece")).withColumn("piece", F.trim("piece")).where("piece <> ''").distinct()
    pieces = pieces.withColumn("id", F.concat_ws(":", "item_id", "piece"))
    found = grams.contained_anywhere(pieces, t("documents"), "id", "piece", "doc_id", "text")
    return found.join(pieces, "id").select("item_id", "piece", "doc_id")


@query("""select d.doc_id file_id, cast(d.doc_id as varchar) number, coalesce(cast(quality as varchar), '') answer, source category, cast(n_chars % 10 + 100 as integer) "year" from documents d left join labels l on d.doc_id = l.doc_id
    where coalesce(cast(quality as varchar), '') = '1' and source = 'src3'""")
def laid_out_index(t):
    """SNK-01, SRC-21, JOI-01: files and questions as bucketed tables, joined in place, looked up by answer and category."""
    index = layout.write_layout(doc_files(t), doc_questions(t).drop("source"), buckets=8)
    found = index.questions.where("answer = '1'").join(index.files.where("category = 'src3'"), "file_id")
    return found.select("file_id", "number", "answer", "category", "year")
