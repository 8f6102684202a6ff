"""Profiling of tables: heads, counts, nulls, value shares, text lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from searchlab.functions.text import word_count

BINS = 40


def head_sample(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Parsed records per table."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def _unpivot(one_row: DataFrame, columns: list[str], name: str) -> DataFrame:
    return one_row.unpivot([], columns, "column", name)


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass."""
    one_row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _unpivot(one_row, df.columns, "n")


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    one_row = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    return _unpivot(one_row, columns, "n")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per non-null value; the ``top`` most frequent, ties by value."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    if top is not None:
        counts = counts.orderBy(F.col("n").desc(), "value").limit(top)
    return counts.select(F.lit(column).alias("column"), "value", "n")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of every non-null value in percent."""
    total = df.agg(F.count(column)).scalar()
    return value_counts(df, column).withColumn("share", F.col("n") * 100.0 / total)


def length_counts(df: DataFrame, text: str) -> DataFrame:
    """``(length, n)``: documents per number of words. One pass over the text; the
    result has at most as many rows as the longest text has words."""
    return df.groupBy(word_count(F.col(text)).cast("long").alias("length")).agg(
        F.count("*").alias("n")
    )


def length_describe(df: DataFrame, text: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles of the word count.

    The deviation is summed around the mean, over distinct lengths.
    """
    n, x = F.col("n"), F.col("length")
    rows = F.sum(n)
    everything = Window.partitionBy()  # over distinct lengths only
    centre = F.sum(n * x).over(everything) / F.sum(n).over(everything)
    squares = F.sum(n * F.pow(x - F.col("mean"), 2.0))
    variance = F.when(rows > 1, squares / (rows - 1))  # one row: none
    quartile = lambda p: F.percentile(x, p, n)
    return length_counts(df, text).withColumn("mean", centre).agg(
        rows.alias("count"),
        F.max("mean").alias("mean"),
        F.sqrt(variance).alias("std"),
        F.min(x).alias("min"),
        quartile(0.25).alias("p25"),
        quartile(0.5).alias("p50"),
        quartile(0.75).alias("p75"),
        F.max(x).alias("max"),
    )


def length_histogram(df: DataFrame, text: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins from the shortest to the longest; the last bin is closed."""
    everything = Window.partitionBy()  # over distinct lengths only
    x = F.col("length")
    bin_number = F.least(F.width_bucket(x, F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    return (
        length_counts(df, text)
        .withColumn("lo", F.min("length").over(everything).cast("double"))
        .withColumn("hi", F.max("length").over(everything).cast("double"))
        # All texts of one length: the bins are centred on it, one unit wide in total.
        .withColumn("flat", F.col("lo") == F.col("hi"))
        .withColumn("lo", F.when(F.col("flat"), F.col("lo") - 0.5).otherwise(F.col("lo")))
        .withColumn("hi", F.when(F.col("flat"), F.col("hi") + 0.5).otherwise(F.col("hi")))
        .groupBy(bin_number.cast("long").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
