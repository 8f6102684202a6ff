"""Strata, proportional allocation and exact-size hash samples.

A sample of n rows is the n rows with the smallest ``md5(seed | key)``: exact in
size for a unique key, repeatable, independent of partitioning. Hashes are uniform,
so the n-th smallest of N lies near ``n / N`` of their range: only hashes in a narrow
bracket around it are ordered, those below it are counted. This reads the key columns
alone. The rows are then taken by one comparison with the n-th hash; they are neither
shuffled nor sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from searchlab.operators.scan import earlier_sums
from searchlab.sources.staging import stage

SEED = 42
BIN_DIGITS = 4  # 16 ** 4 = 65,536 bins
POSITION_DIGITS = 13  # 52 bits, exact in a double
PAST_ALL_HASHES = "g"  # sorts after every hexadecimal text
# Half-widths of the bracket in standard deviations; the last one is everything.
BRACKETS = (8.0, 100.0, float("inf"))
SMALL_STRATA = 65_536  # up to here one task sorts the strata
RARE_LIMIT = 20
RARE_STRATUM = "rare"


def key_hash(*key: str | Column, seed: int = SEED) -> Column:
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hash_bin(digest: Column) -> Column:
    return F.substring(digest, 1, BIN_DIGITS)


def strata_counts(df: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Rows per stratum; null strata are not counted."""
    return df.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("size"))


def rare_labels(counts: DataFrame, stratum: str = "stratum", limit: int = RARE_LIMIT) -> DataFrame:
    """Stratum -> merged stratum: those below ``limit`` rows share one label."""
    return counts.withColumn(
        "merged", F.when(F.col("size") < limit, RARE_STRATUM).otherwise(F.col(stratum))
    )


def allocate(
    sizes: DataFrame, sample_size: int, stratum: str = "stratum", small: int = SMALL_STRATA
) -> DataFrame:
    """Rows to draw from each stratum, proportional to its size.

    Rounded half-even, at least 1, at most the size. What is missing is added one
    row at a time going round from the smallest stratum; what is too much is taken
    one at a time going round from the largest. Equal sizes go by name. ``sizes``
    has one row per stratum, and nothing larger is made of it. More than ``small`` strata
    are range-sorted and summed part by part; the result is the same.
    """
    if sample_size <= 0:
        raise ValueError("sample_size must be positive")
    if sizes.count() > small:
        return _allocate_in_parts(sizes, sample_size, stratum)
    everything = Window.partitionBy()
    total = F.sum("size").over(everything)
    start = F.least(
        F.greatest(
            F.bround(F.col("size") / total * F.lit(sample_size), 0).cast("long"), F.lit(1)
        ),
        F.col("size"),
    )
    rounded = sizes.withColumn("start", start).withColumn(
        "gap", F.lit(sample_size) - F.sum("start").over(everything)
    )
    walk = F.when(F.col("gap") > 0, F.col("size")).otherwise(-F.col("size"))
    capacity = F.when(F.col("gap") > 0, F.col("size") - F.col("start")).otherwise(
        F.col("start") - 1
    )
    # After t turns the strata with less capacity gave all they had, the others t each: the
    # number of full turns follows from sums over the capacities, no unit is made.
    need, first, last = F.abs("gap"), Window.unboundedPreceding, Window.unboundedFollowing
    by_capacity = Window.orderBy("capacity")
    spent = F.coalesce(F.sum("capacity").over(by_capacity.rangeBetween(first, -1)), F.lit(0))
    going = F.count("*").over(by_capacity.rangeBetween(Window.currentRow, last))
    turns = F.floor((need - F.col("spent")) / F.col("going"))
    end = F.struct(
        "capacity", turns.alias("turns"), (need - F.col("spent") - turns * F.col("going")).alias("extra")
    )
    enough = F.col("spent") + F.col("capacity") * F.col("going") >= need
    walked = (
        rounded.withColumn("capacity", capacity)
        .withColumns({"spent": spent, "going": going})
        .withColumn("end", F.min(F.when(enough, end)).over(everything))
        .withColumns({
            "turns": F.coalesce("end.turns", F.max("capacity").over(everything)),
            "extra": F.coalesce("end.extra", F.lit(0).cast("long")),
        })
    )
    more = F.col("capacity") > F.col("turns")
    place = F.row_number().over(Window.partitionBy(more).orderBy(walk, stratum))
    units = F.least("capacity", "turns") + (more & (place <= F.col("extra"))).cast("long")
    return walked.select(
        stratum, "size", (F.col("start") + units * F.signum("gap")).cast("long").alias("n")
    )


def _allocate_in_parts(sizes: DataFrame, sample_size: int, stratum: str) -> DataFrame:
    """The same without a window over all strata: sums over distinct capacities and places are
    running sums over range-sorted parts."""
    total = sizes.agg(F.sum("size")).first()[0]
    even = F.bround(F.col("size") / F.lit(total) * F.lit(sample_size), 0).cast("long")
    rounded = sizes.select(stratum, "size", F.least(F.greatest(even, F.lit(1)), F.col("size")).alias("start"))
    rounded = stage(rounded, "rounded_strata")
    strata, started = rounded.agg(F.count("*"), F.sum("start")).first()
    gap = sample_size - started
    sign, need = (1 if gap > 0 else -1), abs(gap)
    rounded = rounded.withColumn("capacity", F.col("size") - F.col("start") if gap > 0 else F.col("start") - 1)
    counts = rounded.groupBy("capacity").agg(F.count("*").alias("rows"))
    counts = earlier_sums(
        counts.withColumn("given", F.col("capacity") * F.col("rows")), [F.col("capacity")], ["rows", "given"]
    )
    going = F.lit(strata) - F.col("rows_before")
    enough = F.col("given_before") + F.col("capacity") * going >= need
    end, largest = counts.agg(
        F.min(F.when(enough, F.struct("capacity", F.col("given_before").alias("spent"), going.alias("going")))),
        F.max("capacity"),
    ).first()
    # After the full turns a stratum has given ``turns`` rows or all it had; the first ones in order give one more.
    turns, extra = divmod(need - end["spent"], end["going"]) if end else (largest, 0)
    done = rounded.filter(F.col("capacity") <= turns).withColumn("units", F.col("capacity"))
    order = [F.lit(sign) * F.col("size"), F.col(stratum)]
    more = earlier_sums(rounded.filter(F.col("capacity") > turns).withColumn("one", F.lit(1)), order, ["one"])
    more = more.withColumn("units", F.lit(turns) + (F.col("one_before") < extra).cast("long"))
    both = done.unionByName(more.select(*done.columns))
    return both.select(stratum, "size", (F.col("start") + F.col("units") * sign).cast("long").alias("n"))


def _hash_at(position: Column) -> Column:
    """Leading digits of the hash at a place of the hash range, 0 to 1."""
    number = F.floor(position * F.lit(float(16**POSITION_DIGITS)))
    digits = F.lpad(F.lower(F.hex(number)), POSITION_DIGITS, "0")
    return F.when(position <= 0, "").when(position >= 1, PAST_ALL_HASHES).otherwise(digits)


def _with_bracket(quotas: DataFrame, deviations: float) -> DataFrame:
    """Adds ``_low`` and ``_high``, between which the n-th hash is expected."""
    if deviations == float("inf"):
        return quotas.withColumns({"_low": F.lit(""), "_high": F.lit(PAST_ALL_HASHES)})
    share = F.col("n") / F.col("size")
    spread = F.sqrt(share * (1 - share) / F.col("size")) + F.lit(1.0) / F.col("size")
    reach = F.lit(deviations) * spread
    return quotas.withColumns({"_low": _hash_at(share - reach), "_high": _hash_at(share + reach)})


def _nth_digest(digests: DataFrame, group: list[str]) -> DataFrame:
    """``(group, _last_digest)`` from ``(group, _digest, n, _low, _high)``.

    Everything under the bracket is one row per task and group. A group whose n-th
    hash lies outside its bracket is left out.
    """
    upto = Window.partitionBy(*group).orderBy("_inside")
    inside = F.when(F.col("_digest") >= F.col("_low"), F.col("_digest"))
    return (
        digests.filter(F.col("_digest") <= F.col("_high"))
        .groupBy(*group, "n", inside.alias("_inside"))
        .agg(F.count("*").alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(upto))  # the row without hash is first
        .filter(F.col("_inside").isNotNull())
        .filter((F.col("_upto") >= F.col("n")) & (F.col("_upto") - F.col("_rows") < F.col("n")))
        .select(*group, F.col("_inside").alias("_last_digest"))
    )


def stratified_sample(
    df: DataFrame,
    sample_size: int,
    key: list[str],
    stratum: str = "stratum",
    seed: int = SEED,
    rare_limit: int = RARE_LIMIT,
) -> DataFrame:
    """Proportional stratified sample of exactly ``sample_size`` rows.

    ``key`` must identify a row. The whole table comes back when it is not larger
    than the sample. Two small tables with one row per stratum are staged.
    """
    labels = stage(rare_labels(strata_counts(df, stratum), stratum, rare_limit), "strata")
    sizes = labels.groupBy(F.col("merged").alias(stratum)).agg(F.sum("size").alias("size"))
    rows, groups = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if sample_size >= rows:
        return df
    if sample_size < groups:
        raise ValueError(f"{groups} strata need a sample of at least {groups} rows")

    quotas = allocate(sizes, sample_size, stratum).withColumnRenamed(stratum, "merged")
    quotas = stage(labels.select(stratum, "merged").join(quotas, "merged"), "quotas")
    digests = df.select(stratum, key_hash(*key, seed=seed).alias("_digest"))
    for deviations in BRACKETS:
        bounded = digests.join(_with_bracket(quotas, deviations), stratum)
        found = _nth_digest(bounded, ["merged"])
        # Staged, so that its known size keeps the rows below from being shuffled.
        ends = stage(quotas.select(stratum, "merged").join(found, "merged"), "last_digests")
        if ends.count() == quotas.count():
            break
    return (
        df.join(ends.drop("merged"), stratum)
        .filter(key_hash(*key, seed=seed) <= F.col("_last_digest"))
        .select(*df.columns)
    )


def fixed_size_sample(
    df: DataFrame, n: int, key: list[str], seed: int = SEED, allow_fewer: bool = False
) -> DataFrame:
    """Exactly ``n`` rows; fewer only with ``allow_fewer``."""
    if n <= 0:
        raise ValueError("n must be positive")
    rows = df.count()
    if rows < n and not allow_fewer:
        raise ValueError(f"asked for {n} rows, only {rows} are there")
    if rows <= n:
        return df
    digests = df.select(
        key_hash(*key, seed=seed).alias("_digest"),
        F.lit(rows).alias("size"),
        F.lit(n).alias("n"),
    )
    for deviations in BRACKETS:
        last = _nth_digest(_with_bracket(digests, deviations), []).first()
        if last is not None:
            break
    return df.filter(key_hash(*key, seed=seed) <= last["_last_digest"])
