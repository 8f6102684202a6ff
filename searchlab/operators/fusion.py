"""Reciprocal rank fusion (Cormack, Clarke, Buettcher, SIGIR 2009)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from searchlab.operators.topk import rank_top_k

RRF_CONSTANT = 60  # fixed value of the paper


def reciprocal_rank_fusion(
    runs: DataFrame, k: int = 20, doc_col: str = "doc_id", constant: int = RRF_CONSTANT
) -> DataFrame:
    """One list per query from all systems: sum of ``1 / (constant + rank)``."""
    fused = runs.groupBy("query_id", doc_col).agg(
        F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("rrf")
    )
    return rank_top_k(fused, k, ["query_id"], doc_col, "rrf")
