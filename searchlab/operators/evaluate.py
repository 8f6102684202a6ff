"""Graded evaluation of all systems in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PERFECT_GRADE = 3
DEFAULT_K = 10
DEFAULT_THRESHOLD = 2.0


def _check(k: int, threshold: float) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    if not 0 <= threshold <= PERFECT_GRADE:
        raise ValueError(f"the relevance threshold must be between 0 and {PERFECT_GRADE}")


def _discounted_gain(grade: Column, position: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1.0) / F.log2(position + 1)


def ideal_dcg(qrels: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Best possible gain per query from all its judged documents."""
    best = Window.partitionBy("query_id").orderBy(F.col("relevance").desc())
    return (
        qrels.select("query_id", "relevance")
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= k)
        .groupBy("query_id")
        .agg(F.sum(_discounted_gain(F.col("relevance"), F.col("position"))).alias("ideal_dcg"))
    )


def judged_queries(qrels: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Judged and relevant documents per query, with the query's metadata."""
    metadata = [F.min(c).alias(c) for c in ("query", "category") if c in qrels.columns]
    return qrels.groupBy("query_id").agg(
        F.count("*").alias("judged_documents"),
        F.count_if(F.col("relevance") >= threshold).alias("relevant_judged_documents"),
        *metadata,
    )


def _top_rows(runs: DataFrame, qrels: DataFrame, k: int, doc_col: str) -> DataFrame:
    """First k rows of every list by rank, positions without gaps, with grades."""
    by_rank = Window.partitionBy("system", "query_id").orderBy("rank", doc_col)
    top = (
        runs.select("system", "query_id", doc_col, "rank")
        .withColumn("position", F.row_number().over(by_rank))
        .filter(F.col("position") <= k)
    )
    grades = qrels.select("query_id", doc_col, "relevance")
    return top.join(grades, ["query_id", doc_col], "left").withColumn(
        "grade", F.coalesce("relevance", F.lit(0.0))
    )


def metrics_per_query(
    runs: DataFrame,
    qrels: DataFrame,
    k: int = DEFAULT_K,
    threshold: float = DEFAULT_THRESHOLD,
    doc_col: str = "doc_id",
    systems: list[str] | None = None,
) -> DataFrame:
    """One row per system and judged query.

    ``runs(system, query_id, doc, rank[, latency_ms])``, ``qrels(query_id, doc,
    relevance[, query, category])``. An unjudged document has grade 0 and is not
    counted as judged; a judged query without results keeps a row of zeros.
    ``systems`` names systems that may have returned nothing at all.
    """
    _check(k, threshold)
    relevant = F.col("grade") >= threshold
    found = (
        _top_rows(runs, qrels, k, doc_col)
        .groupBy("system", "query_id")
        .agg(
            F.count("*").alias("retrieved"),
            F.count("relevance").alias("judged"),
            F.count_if(relevant).alias("hits"),
            F.min(F.when(relevant, F.col("position"))).alias("first_hit"),
            F.sum(_discounted_gain(F.col("grade"), F.col("position"))).alias("dcg"),
        )
    )
    named = (
        F.array(*[F.lit(s) for s in systems])
        if systems
        else runs.agg(F.collect_set("system")).scalar()
    )
    expected = (
        judged_queries(qrels, threshold)
        .join(ideal_dcg(qrels, k), "query_id")
        .withColumn("system", F.explode(named))
    )
    scored = expected.join(found, ["system", "query_id"], "left")

    def or_zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("long"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    columns = [
        "system",
        "query_id",
        or_zero("retrieved").alias(f"retrieved_at_{k}"),
        or_zero("judged").alias(f"judged_at_{k}"),
        share(or_zero("judged"), or_zero("retrieved")).alias(f"judgement_coverage_at_{k}"),
        "judged_documents",
        "relevant_judged_documents",
        share(F.coalesce("dcg", F.lit(0.0)), F.col("ideal_dcg")).alias(f"ndcg_at_{k}"),
        F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)).alias(f"mrr_at_{k}"),
        (or_zero("hits") / F.lit(k)).alias(f"precision_at_{k}"),
        share(or_zero("hits"), F.col("relevant_judged_documents")).alias(f"recall_at_{k}"),
        *[c for c in ("query", "category") if c in qrels.columns],
    ]
    if "latency_ms" not in runs.columns:
        return scored.select(*columns)
    latency = (
        runs.withColumn("latency_ms", F.col("latency_ms").try_cast("double"))
        .filter(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms"))
        .groupBy("system", "query_id")
        .agg(F.min_by("latency_ms", "rank").alias("latency_ms"))
    )
    return scored.join(latency, ["system", "query_id"], "left").select(*columns, "latency_ms")


def judgement_coverage(
    runs: DataFrame, qrels: DataFrame, k: int = DEFAULT_K, doc_col: str = "doc_id"
) -> DataFrame:
    """Retrieved and judged documents per system and query."""
    per_query = metrics_per_query(runs.drop("latency_ms"), qrels, k, doc_col=doc_col)
    return per_query.select(
        "system",
        "query_id",
        F.col(f"retrieved_at_{k}"),
        F.col(f"judged_at_{k}"),
        F.col(f"judgement_coverage_at_{k}"),
        "judged_documents",
        "relevant_judged_documents",
    )


def _quality(k: int) -> list[str]:
    return [f"{m}_at_{k}" for m in ("ndcg", "mrr", "precision", "recall")]


def summary_by_system(per_query: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Means per system; the p95 interpolates linearly.

    The state of ``percentile`` is one count per distinct latency of a system, that
    is at most one per query.
    """
    aggregates = [
        F.count_distinct("query_id").alias("query_count"),
        F.avg(f"judgement_coverage_at_{k}").alias("mean_judgement_coverage_at_k"),
        *[F.avg(c).alias(c) for c in _quality(k)],
    ]
    if "latency_ms" in per_query.columns:
        aggregates += [
            F.avg("latency_ms").alias("mean_latency_ms"),
            F.percentile("latency_ms", 0.95).alias("p95_latency_ms"),
        ]
    return per_query.groupBy("system").agg(*aggregates)


def summary_by_category(per_query: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Means per system and category; queries without a category are left out."""
    if "category" not in per_query.columns:
        per_query = per_query.withColumn("category", F.lit(None).cast("string"))
    return (
        per_query.filter(F.col("category").isNotNull())
        .groupBy("system", "category")
        .agg(
            F.count_distinct("query_id").alias("query_count"),
            *[F.avg(c).alias(c) for c in _quality(k)],
        )
    )


def coverage_warnings(per_query: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Results per system whose top k is not fully judged."""
    return per_query.groupBy("system").agg(
        F.count_if(F.col(f"judgement_coverage_at_{k}") < 1).alias("incomplete"),
        F.count("*").alias("results"),
    )
