"""Distinct rows and keep-first distinct on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct; nulls compare equal."""
    return df.dropDuplicates()


def keep_first(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must be a total order.

    The ``= 1`` filter lets Spark cut every group to one row per task before
    the shuffle, so a key with very many copies costs one row per task.
    """
    first = Window.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("_position", F.row_number().over(first))
        .filter(F.col("_position") == 1)
        .drop("_position")
    )
