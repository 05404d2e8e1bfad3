"""Helpers for the registries: a query over the derived tables and its SQL over the same tables in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.fixtures import Tables, duckdb_tables


class Registry:
    """Queries by name, and SQL for those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        """query takes the derived tables; sql follows their common table expressions and may add its own, after a comma."""
        self.queries[name] = lambda spark, sf_dir: query(Tables(spark, sf_dir))
        if sql:
            self.sql[name] = duckdb_tables() + "\n" + sql
