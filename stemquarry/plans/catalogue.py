"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import aggregate_queries, corpus_queries, index_queries, paper_queries, repair_queries, rule_queries, search_queries, sequence_queries, stream_queries, text_queries  # noqa: F401  they register themselves
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "keyword_search"
