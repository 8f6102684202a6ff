"""Exact linear quantiles of groups of any size, and latency statistics.

``percentile`` keeps every distinct value of a group in one task, so it serves groups of at most
``SMALL`` values. The values of larger groups are narrowed down by radix selection: a double has
a whole number of 64 bits in the same order; values are counted by their first 16 bits, which tells those
of the wanted rank, and only the values that share them are counted by the next 16, four times. Counts are combined before they are
shuffled, and a group has at most 65,536 of them, whatever its values and their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from searchlab.sources.staging import stage

SMALL = 65_536
DIGIT_BITS = 16
MANTISSA_BITS, BIAS = 52, 1023  # of a double
LEAST_NORMAL, LEAST = 2.0**-1022, 2.0**-1074


def ordered_bits(value: Column) -> Column:
    """A whole number for each double, in the same order: its bits, negated for negative ones.

    Not a number comes last; both zeros are equal.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    # The logarithm may round across a power of two.
    power = guess + (F.pow(F.lit(2.0), guess + 1) <= size).cast("int") - (F.pow(F.lit(2.0), guess) > size).cast("int")
    mantissa = (size / F.pow(F.lit(2.0), power) - 1) * 2.0**MANTISSA_BITS
    infinite = F.lit((2 * BIAS + 1) << MANTISSA_BITS)
    bits = (
        F.when(F.isnan(value), infinite + 1)
        .when(size == float("inf"), infinite)
        .when(size < LEAST_NORMAL, (size / LEAST).cast("long"))
        .otherwise((power + BIAS) * F.lit(1 << MANTISSA_BITS) + mantissa.cast("long"))
    )
    return F.when(value < 0, -bits).otherwise(bits)


def _digit(bits: Column, level: int) -> Column:
    shift = 64 - DIGIT_BITS * (level + 1)
    digit = F.shiftright(bits, shift)  # keeps the sign in the first digit
    return digit if level == 0 else digit.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))


def _holding(counts: Column, rank: Column) -> Column:
    """(digit, before) of the digit at ``rank`` (from 0) in sorted (digit, n); ``before``: values of smaller digits."""
    start = F.struct(F.lit(None).cast("long").alias("digit"), F.lit(0).cast("long").alias("before"))

    def step(found: Column, count: Column) -> Column:
        reached = found["before"] + count["n"] > rank
        return F.when(found["digit"].isNotNull(), found).when(
            reached, F.struct(count["digit"].alias("digit"), found["before"].alias("before"))
        ).otherwise(F.struct(found["digit"].alias("digit"), (found["before"] + count["n"]).alias("before")))

    return F.aggregate(counts, start, step)


def _selected(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(group, rank, value)``: the values at ``ranks`` (group, rank) of ``values`` (group, v)."""
    left = values.withColumn("bits", ordered_bits(F.col("v"))).join(ranks.withColumn("left", F.col("rank")), "group")
    for level in range(64 // DIGIT_BITS):
        counts = (
            left.groupBy("group", "rank", "left", _digit(F.col("bits"), level).alias("digit"))
            .agg(F.count("*").alias("n"), F.min("v").alias("v"))
            .groupBy("group", "rank", "left")
            .agg(F.sort_array(F.collect_list(F.struct("digit", "n", "v"))).alias("counts"))
        )
        found = counts.withColumn("found", _holding(F.col("counts"), F.col("left"))).select(
            "group", "rank", (F.col("left") - F.col("found.before")).alias("next"), F.col("found.digit").alias("wanted"),
            F.filter("counts", lambda c: c["digit"] == F.col("found.digit"))[0]["v"].alias("value"),
        )
        found = stage(found, "digits")
        if level == 64 // DIGIT_BITS - 1:
            return found.select("group", "rank", "value")
        left = stage(
            left.join(found.drop("value"), ["group", "rank"])
            .filter(_digit(F.col("bits"), level) == F.col("wanted"))
            .select("group", "rank", F.col("next").alias("left"), "bits", "v"),
            "narrowed",
        )


def exact_quantile(
    df: DataFrame, group: str, value: str, p: float, name: str, small: int = SMALL
) -> DataFrame:
    """``(group, name)``: quantile ``p`` with linear interpolation, nulls ignored.

    Groups of more than ``small`` values take the radix selection; the result is the same.
    Null groups have no row.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    values = df.select(F.col(group).alias("group"), (F.col(value).cast("double") + 0.0).alias("v"))
    values = values.filter("group is not null and v is not null")
    sizes = stage(values.groupBy("group").agg(F.count("*").alias("n")), "group_sizes")
    large = sizes.filter(F.col("n") > small)
    few = values.join(sizes.filter(F.col("n") <= small), "group", "left_semi")
    parts = [few.groupBy("group").agg(F.percentile("v", p).alias(name))]
    if not large.isEmpty():
        at = (F.col("n") - 1) * F.lit(p)
        ranks = large.select("group", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
        many = values.join(large, "group", "left_semi")
        ends = _selected(many, ranks).groupBy("group").agg(F.min("value").alias("a"), F.max("value").alias("b"))
        between = F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))
        exact = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between)
        parts.append(large.join(ends, "group").select("group", exact.alias(name)))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("group", group)


def latency_stats(df: DataFrame, group: str = "system", value: str = "latency_ms") -> DataFrame:
    """Mean, p95, smallest and largest value per group."""
    simple = df.groupBy(group).agg(
        F.avg(value).alias("mean_latency_ms"),
        F.min(value).alias("min_latency_ms"),
        F.max(value).alias("max_latency_ms"),
    )
    return simple.join(exact_quantile(df, group, value, 0.95, "p95_latency_ms"), group, "left")
