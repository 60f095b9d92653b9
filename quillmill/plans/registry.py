"""The registered queries and, where SQL can say the same, their statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
STATEMENTS: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            STATEMENTS[key] = sql.strip()
        return fn

    return register


def joined(array: Column) -> Column:
    """An array as text, so that engines print it alike."""
    return F.array_join(array.cast("array<string>"), ",")


def rounded(value: Column) -> Column:
    return F.round(value, 6)
