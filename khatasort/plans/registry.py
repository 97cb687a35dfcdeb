"""Named statement queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cascade_queries, learning_queries, report_queries, source_queries, text_queries

GROUPS = (source_queries, text_queries, cascade_queries, report_queries, learning_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for group in GROUPS for name, run in group.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.oracle_sql().items()}
