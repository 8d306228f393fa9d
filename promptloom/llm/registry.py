"""Registered queries of this subpackage and, where SQL can say the same, their check query."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check in DuckDB."""
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run
    return add


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
