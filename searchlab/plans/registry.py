"""Registration of catalogue queries together with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            CHECK_SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six digits, as in the check SQL."""
    return df.withColumns({c: F.round(c, 6) for c in columns})
