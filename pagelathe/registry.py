"""The registered queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelathe.plans import evidence_queries, item_queries, layout_queries, source_queries, text_queries

_PARTS = (text_queries, layout_queries, evidence_queries, item_queries, source_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for p in _PARTS for name, f in p.QUERIES.items()}

ORACLE_SQL: dict[str, str] = {name: sql for p in _PARTS for name, sql in p.ORACLE_SQL.items()}

FLAGSHIP = "line_profile"
