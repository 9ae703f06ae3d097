"""All queries outside the llm subpackage."""

from __future__ import annotations

from . import corpus_queries, events, pricing_queries, stream_queries, topic_queries

_PARTS = (events, corpus_queries, topic_queries, pricing_queries, stream_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
