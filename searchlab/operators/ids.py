"""Gap-free document numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from searchlab.operators.sampling import SEED, hash_bin, key_hash


def assign_document_ids(
    df: DataFrame, key: list[str], name: str = "job_id", prefix: str = "JOB_", seed: int = SEED
) -> DataFrame:
    """``JOB_0000001`` upwards, in the order of ``md5(seed | key)``; ``key`` is unique.

    The number is the count of rows in all lower hash bins plus the place inside
    the bin. Both depend on the data only, so a retried task repeats them. The
    table of bin offsets has at most 65,536 rows and is broadcast.
    """
    binned = df.withColumn("_digest", key_hash(*key, seed=seed)).withColumn(
        "_bin", hash_bin(F.col("_digest"))
    )
    offsets = (
        binned.groupBy("_bin")
        .agg(F.count("*").alias("_rows"))
        .select(
            "_bin",
            (F.sum("_rows").over(Window.orderBy("_bin")) - F.col("_rows")).alias("_offset"),
        )
    )
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("_digest", *key))
    number = F.col("_offset") + F.col("_place")
    return (
        binned.withColumn("_place", place)
        .join(F.broadcast(offsets), "_bin")
        .withColumn(name, F.format_string(f"{prefix}%07d", number))
        .drop("_digest", "_bin", "_offset", "_place")
    )
