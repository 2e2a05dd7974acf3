"""Registry of named queries, each with the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def register(name: str, *operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Name a query, list the operators it covers, and give the SQL it must agree with."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        QUERIES[name] = prepared
        OPERATORS[name] = operators
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep
