"""Sinks. Large tables go to Parquet; reports to CSV or JSON in their usual order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from searchlab.sources.staging import new_location


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_vectors(vectors: DataFrame, path: str, partition_by: str | None = None) -> None:
    """``partition_by``: ``dim`` for reduced vectors, ``cell`` for a cell index."""
    writer = vectors.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_run(run: DataFrame, path: str, as_csv: bool = False) -> None:
    """Parquet with one folder per system, or CSV."""
    if as_csv:
        run.orderBy("system", "query_id", "rank").write.mode("overwrite").csv(path, header=True)
    else:
        run.write.mode("overwrite").partitionBy("system").parquet(path)


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """Small report as CSV in a stated order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """One record per system or parameter value."""
    metrics.write.mode("overwrite").json(path)


def through_csv(df: DataFrame, name: str) -> str:
    """Where ``df`` was staged as CSV, in the form of the raw files."""
    location = new_location(df.sparkSession, name)
    df.write.csv(
        location, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return location


def run_metrics(run: DataFrame, latency: DataFrame, k: int) -> DataFrame:
    """Record of a search: queries, depth and latency statistics per system."""
    queries = run.groupBy("system").agg(F.count_distinct("query_id").alias("query_count"))
    return queries.withColumn("top_k", F.lit(k)).join(latency, "system", "left")


def write_pool(pool: DataFrame, path: str, doc_col: str = "doc_id") -> None:
    pool.orderBy("query_id", "best_rank", doc_col).write.mode("overwrite").csv(path, header=True)


def write_evaluation(
    per_query: DataFrame, summary: DataFrame, by_category: DataFrame, folder: str, k: int = 10
) -> None:
    """Three CSV tables; the one by category only when there are categories."""
    best = F.col(f"ndcg_at_{k}").desc()
    per_query.orderBy("system", "query_id").write.mode("overwrite").csv(
        f"{folder}/per_query_metrics", header=True
    )
    summary.orderBy(best, "system").write.mode("overwrite").csv(
        f"{folder}/summary_metrics", header=True
    )
    if not by_category.isEmpty():
        by_category.orderBy("category", best, "system").write.mode("overwrite").csv(
            f"{folder}/category_metrics", header=True
        )
