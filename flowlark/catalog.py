"""All queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlark.plans import behaviour_queries, fuzzy_queries, group_queries, session_queries

FLAGSHIP = "sessions"
_FOUND = session_queries.FOUND | behaviour_queries.FOUND | group_queries.FOUND | fuzzy_queries.FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
