"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that must give the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def big(col: str | Column, name: str | None = None) -> Column:
    """Cast to BIGINT and keep the name."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint").alias(name or col)


def rounded(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6).alias(name or col)
