"""Pooling of several ranked lists into one set of documents to grade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from searchlab.sources.staging import stage

METADATA = ["query", "category"]
TO_FILL = ["relevance", "annotator", "notes"]


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """All lists with the label of their system; missing columns become null."""
    if not runs:
        raise ValueError("at least one run is required")
    labelled = [run.withColumn("system", F.lit(name)) for name, run in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def pool_candidates(
    runs: DataFrame, source_top_k: int = 10, max_candidates: int = 20, doc_col: str = "doc_id"
) -> DataFrame:
    """Documents any system ranked in its first ``source_top_k``.

    Per query at most ``max_candidates``: most systems first, then best rank, then id.
    """
    if source_top_k <= 0 or max_candidates <= 0:
        raise ValueError("source_top_k and max_candidates must be positive")
    metadata = [F.min(c).alias(c) for c in METADATA if c in runs.columns]
    systems = F.array_sort(F.collect_set("system"))
    candidates = (
        runs.filter(F.col("rank") <= source_top_k)
        .groupBy("query_id", doc_col)
        .agg(
            *metadata,
            F.array_join(systems, ", ").alias("source_systems"),
            F.size(F.collect_set("system")).cast("long").alias("system_count"),
            F.min("rank").alias("best_rank"),
        )
    )
    priority = Window.partitionBy("query_id").orderBy(
        F.col("system_count").desc(), "best_rank", doc_col
    )
    return (
        candidates.withColumn("_place", F.row_number().over(priority))
        .filter(F.col("_place") <= max_candidates)
        .drop("_place")
    )


def annotation_pool(
    candidates: DataFrame, corpus: DataFrame, metadata: list[str], doc_col: str = "doc_id"
) -> DataFrame:
    """Candidates with document metadata and empty columns for the graders.

    Empty metadata of a known document is ``''``; a document that the corpus does
    not hold keeps null. The candidates are staged: their known size lets the corpus
    be cut down to them where it lies, before the outer join.
    """
    candidates = stage(candidates, "candidates")
    known = (
        corpus.select(doc_col, *metadata)
        .join(candidates.select(doc_col), doc_col, "left_semi")
        .fillna("")
    )
    blanks = [F.lit("").alias(c) for c in TO_FILL]
    leading = ["query_id", *[c for c in METADATA if c in candidates.columns], doc_col]
    return candidates.join(known, doc_col, "left").select(
        *leading, *metadata, "source_systems", "system_count", "best_rank", *blanks
    )


def pool_stats(pool: DataFrame) -> DataFrame:
    """Candidates per query: fewest, mean, most."""
    return (
        pool.groupBy("query_id")
        .agg(F.count("*").alias("n"))
        .agg(
            F.min("n").alias("min_candidates"),
            F.avg("n").alias("mean_candidates"),
            F.max("n").alias("max_candidates"),
        )
    )
