"""All queries of the engine proper, with the DuckDB SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.plans import answer_queries, code_queries, definition_queries, export_queries, graph_queries, more_queries, outline_queries, pack_queries, rule_queries, source_queries, stream_queries, symbol_queries, table_queries, text_queries

MODULES = (graph_queries, table_queries, more_queries, rule_queries, code_queries, text_queries, source_queries, answer_queries, stream_queries, definition_queries, pack_queries, outline_queries, export_queries, symbol_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query behind entry(): a batched call neighbourhood."""
    return graph_queries.call_neighborhood(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
