"""The registry of queries and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str = "", sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``; ``covers`` lists blueprint ids."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
