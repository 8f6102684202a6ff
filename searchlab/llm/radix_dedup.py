"""Exact dedup by distributed most-significant-byte-first radix partitioning.

Documents are split by their first bytes, then each group by its next bytes, and so on,
until a group has one document or its texts have ended. Equality is decided by the bytes
alone. Level 0 reads ``FIRST`` bytes, each following level ``GROWTH`` times as many, so that
the number of levels grows with the logarithm of the longest repeated text.

A group that is split is found by an aggregate over (group, bytes), which Spark combines
before the shuffle: any number of copies leaves one row for each task. To bring the result back,
rows carry one of ``SALTS`` salts; the aggregate notes which salts occur, and the join is
on (group, bytes, salt), so a group with a third of all rows is spread over many tasks.
After level 0 only the documents of groups with two or more members go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from searchlab.llm.common import document_columns, fresh_name
from searchlab.sources.staging import stage

FIRST = 64
GROWTH = 8
SALTS = 64


def _groups(rows: DataFrame, level: int) -> DataFrame:
    """Groups of two or more rows: their number, their largest id, a new group number."""
    found = (
        rows.groupBy("part", "bytes")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.max("doc_id").alias("largest"),
            F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salt_bits"),
        )
        .filter("members > 1")
        .withColumn("next_part", F.monotonically_increasing_id())
    )
    salts = F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)),
        lambda s: F.expr("salt_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0,
    )
    return stage(found, f"radix_groups_{level}").withColumn("salt", F.explode(salts)).drop("salt_bits")


def _split(rows: DataFrame, width: int, level: int) -> DataFrame:
    """One level: rows (doc_id, part, rest, keyed columns) with what became of each."""
    keyed = rows.withColumns({
        "bytes": F.substring("rest", 1, width),
        "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"),
    })
    groups = _groups(keyed, level).withColumnsRenamed(
        {"part": "g_part", "bytes": "g_bytes", "salt": "g_salt"}
    )
    # `part` is never null; equal bytes and part are one group.
    same = (
        (F.col("part") == F.col("g_part")) & (F.col("bytes") == F.col("g_bytes"))
        & (F.col("salt") == F.col("g_salt"))
    )
    alone: Column = F.col("members").isNull()
    ended = F.octet_length("bytes") < width
    done = alone | ended
    # One kind of join at every size: the groups grow with the data.
    result = keyed.join(groups.hint("merge"), same, "left").select(
        "doc_id", "text_sha256", done.alias("done"),
        F.when(alone, F.col("doc_id")).when(ended, F.col("largest")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).when(ended, F.col("members")).alias("group_size"),
        F.when(~done, F.col("next_part")).alias("part"),
        F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
    )
    return stage(result, f"radix_level_{level}")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts
    the largest id stays (``kept``); null ids lose against others. Where all ids of a
    group are null, ``keep_id`` is null and its rows, which nothing tells apart, are all
    ``kept``; so are rows that repeat both the largest id and the text. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = document_columns(docs, id_col, text_col).select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.lit(0).cast("long").alias("part"), F.col("text").cast("binary").alias("rest"),
    )
    width, level, finished = FIRST, 0, []
    while True:
        split = _split(rows, width, level)
        finished.append(split.filter("done").select("doc_id", "keep_id", "group_size", "text_sha256"))
        rows = split.filter("not done").select("doc_id", "text_sha256", "part", "rest")
        if rows.isEmpty():
            break
        width, level = width * GROWTH, level + 1
    united = reduce(DataFrame.unionByName, finished)
    return united.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that agree in id
    and text one is kept."""

    def key(name: str, digest) -> Column:
        return F.concat_ws(":", F.coalesce(F.col(name).cast("string"), F.lit("null")), digest)

    name = fresh_name(docs, "row_key")
    kept = exact_groups(docs, id_col, text_col).filter("kept")
    kept = kept.select(key("doc_id", F.col("text_sha256")).alias(name)).hint("merge")
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    rows = docs.withColumn(name, key(id_col, digest))
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
