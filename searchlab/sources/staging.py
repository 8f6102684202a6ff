"""Intermediate tables written to the shared folder of the cluster.

A staged table survives the loss of executors, is read back column by column,
and its size on disk is known to the optimizer: joins against it broadcast only
when the measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="searchlab-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_location(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/searchlab/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    location = new_location(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)
