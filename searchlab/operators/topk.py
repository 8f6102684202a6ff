"""Ranked lists: numbering and top-k per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SCORE_DIGITS = 12  # significant digits by which scores are told apart
TINY = 1e-100  # scores nearer to zero than this count as zero


def significant(score: Column) -> Column:
    """``score`` to ``SCORE_DIGITS`` significant digits, whatever its magnitude.

    Sums of the same numbers in another order agree this far, so equal documents stay
    tied, while scores of any size that really differ keep their order.
    """
    size = F.greatest(F.abs(score), F.lit(TINY))
    scale = F.pow(F.lit(10.0), F.lit(SCORE_DIGITS - 1) - F.floor(F.log10(size)))
    return F.when(F.abs(score) < TINY, 0.0).otherwise(F.rint(score * scale) / scale)


def rank_top_k(
    scored: DataFrame, k: int, query_cols: list[str], doc_col: str, score_col: str = "score"
) -> DataFrame:
    """First ``k`` rows per query by score, ties by document; ``rank`` from 1.

    The score is passed on as it is. The filter on the row number gives every task its
    own limit of k before the shuffle on the query.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    best_first = Window.partitionBy(*query_cols).orderBy(F.col("_score_key").desc(), doc_col)
    return (
        scored.withColumn("_score_key", significant(F.col(score_col)))
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
        .drop("_score_key")
    )
