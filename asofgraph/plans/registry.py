"""All queries of the engine by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from asofgraph.plans import graph_queries, market_queries, source_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


MODULES = (graph_queries, market_queries, text_queries, source_queries)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(module.ORACLE)
    return found
