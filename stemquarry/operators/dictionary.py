"""Word splitting and joining with a dictionary of any size.

The dictionary stays a table.  What a text may ask it for is known beforehand (the substrings of its
letter runs, its neighbouring tokens joined), so that goes to the dictionary by a join, each distinct
run once, and a run comes back with the few words that it holds.  No task and no driver holds the
dictionary; a run that very many texts have is one row until it is joined back, and that join reads
written tables, so Spark splits its partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import udfs
from ..sources.scratch import saved

#: Letters of the longest piece that is looked up.
LONGEST = 24


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, word): lower-case substrings of a run's parts of six letters or more."""
    for batch in batches:
        runs, words = [], []
        for run in batch.column("run").to_pylist():
            for part in udfs.run_pieces(run):
                low = part.lower()
                found = {low[i : i + k] for i in range(len(low)) for k in range(1, min(LONGEST, len(low) - i) + 1)} if len(low) >= 6 else ()
                runs += [run] * len(found)
                words += found
        yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(words, pa.string())], names=["run", "word"])


@F.pandas_udf(T.StringType())
def _split(runs: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([udfs.split_run(r, {w["word"]: w["n"] for w in words} if words is not None else {}) for r, words in zip(runs, known, strict=True)], dtype=object)


def split_words(texts: DataFrame, key: str, text: str, words: DataFrame, least: int = 8) -> DataFrame:
    """TXT-18..20: ``texts`` with each run of ``least`` or more letters split by words(word, n).

    The same splits as ``udfs.segment_words`` makes with the dictionary in memory.  ``key`` identifies rows.
    """
    runs = saved(texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"[A-Za-z]{{{least},}}"), F.lit(0)))).alias("run")), "runs")
    distinct = saved(runs.select("run").distinct(), "distinct-runs")
    pieces = distinct.mapInArrow(_pieces, "run string, word string").distinct()
    known = pieces.join(words.groupBy("word").agg(F.max("n").alias("n")), "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # what one run holds
    split = distinct.join(known, "run", "left").select("run", _split("run", "known").alias("split")).where("run <> split")
    changed = runs.join(saved(split, "splits"), "run").groupBy(key).agg(F.collect_set(F.struct("run", "split")).alias("_splits"))  # what one text holds

    @F.pandas_udf(T.StringType())
    def replaced(column: pd.Series, splits: pd.Series) -> pd.Series:
        rx, out = re.compile(f"[A-Za-z]{{{least},}}"), []
        for x, found in zip(column, splits, strict=True):
            table = {s["run"]: s["split"] for s in found} if found is not None else {}
            out.append(rx.sub(lambda m: table.get(m[0], m[0]), x) if x is not None and table else x)  # noqa: B023
        return pd.Series(out, dtype=object)

    return texts.join(changed, key, "left").withColumn(text, replaced(text, "_splits")).select(texts.columns)


def join_fragments(texts: DataFrame, key: str, text: str, words: DataFrame, standalone: tuple[str, ...] = ()) -> DataFrame:
    """TXT-22/23: ``texts`` with fragments joined into words of words(word), as ``udfs.merge_text`` does. ``key`` identifies rows."""
    kind = dict(texts.dtypes)[key]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = [p.lower() if re.fullmatch("[A-Za-z]+", p) else "" for p in (x or "").split(" ")]
                own = {"".join(tokens[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(tokens) - n + 1) if all(tokens[i : i + n])}
                keys += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.string())], names=["key", "word"])

    candidates = saved(texts.select(key, text).mapInArrow(asked, f"key {kind}, word string"), "candidates")
    known = candidates.join(words.select("word").distinct(), "word").groupBy(F.col("key").alias(key)).agg(F.collect_set("word").alias("_known"))  # what one text holds

    @F.pandas_udf(T.StringType())
    def merged(column: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or w is None else udfs.merge_text(x, set(w), standalone) for x, w in zip(column, known, strict=True)], dtype=object)

    return texts.join(known, key, "left").withColumn(text, merged(text, "_known")).select(texts.columns)
