"""A table function for spans: many patterns in one pass over a text (used in a lateral join)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@F.udtf(returnType="rule string, start int, end int, text string")
class Spans:
    """TXT-30, DET-05: (rule, start, end, text) of every match of every pattern, code points, end exclusive.

    ``rules`` is a JSON object of patterns by rule; ``apart`` keeps, of spans that overlap (in order of
    start, end and rule), the first (SET-06).
    """

    def __init__(self) -> None:
        self.known: dict[str, list[tuple[str, re.Pattern]]] = {}

    def eval(self, text: str, rules: str, apart: bool) -> Iterator[tuple[str, int, int, str]]:
        if text is None:
            return
        if rules not in self.known:
            self.known[rules] = [(k, re.compile(p)) for k, p in json.loads(rules).items()]
        found = sorted((m.start(), m.end(), k, m[0]) for k, rx in self.known[rules] for m in rx.finditer(text))
        end = -1
        for a, b, rule, part in found:
            if not apart or a >= end:
                end = b
                yield rule, a, b, part


def with_spans(df: DataFrame, text: str | Column, rules: dict[str, str], apart: bool = False) -> DataFrame:
    """Each row once for every span of its text, by a lateral join; rows without a span go."""
    column = F.col(text) if isinstance(text, str) else text
    return df.lateralJoin(Spans(column.outer(), F.lit(json.dumps(rules, ensure_ascii=False)), F.lit(apart)))
