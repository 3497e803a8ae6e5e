"""Corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemquarry.llm.cost_packing import pack_documents
from stemquarry.llm.passage_dedup import without_repeats
from stemquarry.llm.quality_crf import fit_model, good_documents
from stemquarry.llm.runtime import Scratch, except_ids, only_ids, remove
from stemquarry.llm.secret_dfa import redacted
from stemquarry.llm.set_join import jaccard_components


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose line-CRF quality score is below the cut (0.3).

    Null and empty texts are one empty line and are scored like any other; repeated rows are scored
    one by one; a null id is scored; an empty table gives no rows; without two classes of labels every
    score is their share of label 1 (0.5 without labels).  All columns stay as they are.
    """
    return good_documents(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by shingle-set Jaccard 0.8: the smallest id.

    Rows of one id are one document: they stay or go together.  Of rows that share an id and a text one
    stays (the least as JSON); different texts of an id that stays all stay with it.  Documents without
    words, which are linked with nothing, stay; so does a null id.  An empty table gives no rows.  All
    columns stay as they are, of any name and type.
    """
    scratch = Scratch(spark, "near-duplicates")
    groups = scratch.save(jaccard_components(docs), "groups")
    dropped = scratch.save(groups.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    repeated = scratch.save(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = except_ids(docs, dropped, dropped.count())
    n_repeated = repeated.count()
    if not n_repeated:
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    firsts = only_ids(kept, repeated, n_repeated).groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return except_ids(kept, repeated, n_repeated).unionByName(firsts.select(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document (of smaller id) holds; n_chars follows the text.

    Null, empty and short texts stay as they are, as do rows with a null id; rows that share an id
    count as one document and lose a passage only where they hold it; repeats within a document
    stay; an empty table gives no rows; other columns stay as they are.
    """
    return without_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are scanned one by one; overlapping secrets
    are one mark; an empty table gives no rows; other columns stay as they are.
    """
    return redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into token sequences.

    Null and empty texts are the single id 0; repeated rows are packed one by one; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    return pack_documents(
        docs, json_path=public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first_copies),
    ("passages", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Models, automata and token ids aren't expressible in SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's table goes when the next stage's is written; the last stage reads the one that stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = Scratch(spark, f"pipeline-{uuid.uuid4().hex}").base
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        if i:
            remove(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
