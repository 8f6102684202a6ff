"""Input views of the registered queries, derived from whole tables.

Text track: ``documents`` as corpus, ``benchmark`` passages as queries.
Vector track: ``embeddings`` as corpus, the mean vector of every label as query.
``views_sql`` states the same views as SQL text.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from searchlab.functions.vectors import unit_vector
from searchlab.operators.ann import assign_cells, pivot_centroids, search_cells
from searchlab.operators.dense import exact_top_k
from searchlab.operators.pool import pool_candidates, union_runs
from searchlab.operators.reduction import Projection, mean_vector, project
from searchlab.sources.staging import stage

CELLS = 16
PROBES = 4
REDUCED = 8
POOL_DEPTH = 8
POOL_LIMIT = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line as title, second as skills, the rest as summary."""
    lines = F.split("text", "\n")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            lines[0].alias("title"),
            F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("skills"),
            F.array_join(
                F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), " "
            ).alias("summary"),
            F.col("lang").alias("country"),
            F.col("source").alias("company"),
            F.coalesce(F.concat(F.lit("q"), F.col("quality")), F.lit("unknown")).alias("level"),
        )
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("Q"), F.col("item_id")).alias("query_id"),
        F.col("text").alias("query"),
        F.concat(F.lit("cat"), F.col("item_id") % 5).alias("category"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", "label"
    )


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = array_to_vector(F.col("embedding").cast("array<double>"))
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy("label")
        .agg(vector_to_array(Summarizer.mean(features)).alias("mean"))
    )


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: its mean vector, scaled to unit length."""
    return label_means(spark, sf_dir).select(
        F.concat(F.lit("V"), F.col("label")).alias("query_id"),
        unit_vector(F.col("mean")).alias("qvec"),
        F.col("label").alias("qlabel"),
        F.concat(F.lit("cat"), F.col("label") % 4).alias("category"),
    )


def staged_vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(vec_queries(spark, sf_dir), "vec_queries")


def run_exact(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    return exact_top_k(vectors, asked)


def label_basis(vectors: DataFrame, asked: DataFrame) -> Projection:
    """Means of the ``REDUCED`` first labels as axes: a projection that SQL can repeat."""
    rows = asked.orderBy("qlabel").select("qvec").limit(REDUCED).collect()
    return Projection(np.array(mean_vector(vectors)), np.array([r["qvec"] for r in rows]))


def run_reduced(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    basis = label_basis(vectors, asked)
    small = stage(project(asked.select("query_id", "qvec"), basis, None, "qvec"), "reduced_queries")
    return exact_top_k(project(vectors.select("doc_id", "embedding"), basis), small)


def centroids(vectors: DataFrame) -> DataFrame:
    return stage(pivot_centroids(vectors, CELLS), "centroids")


def run_cells(vectors: DataFrame, asked: DataFrame, pivots: DataFrame) -> DataFrame:
    assigned = assign_cells(vectors, pivots)
    return search_cells(assigned, asked, pivots, [PROBES]).drop("nprobe")


def cells_label() -> str:
    return f"ivf_c{CELLS}_p{PROBES}"


def vector_runs(spark: SparkSession, sf_dir: str, latency: bool = False) -> DataFrame:
    """Exact, shortened and approximate run with query metadata, staged."""
    vectors, asked = embeddings(spark, sf_dir), staged_vec_queries(spark, sf_dir)
    runs = union_runs(
        {
            "dense_flat": run_exact(vectors, asked),
            f"dense_reduced{REDUCED}": run_reduced(vectors, asked),
            cells_label(): run_cells(vectors, asked, centroids(vectors)),
        }
    )
    runs = runs.join(asked.select("query_id", "qlabel", "category"), "query_id").withColumns(
        {
            "query": F.concat(F.lit("label "), F.col("qlabel")),
            "score": F.round("score", 6) + 0.0,
        }
    )
    if latency:
        offset = F.when(F.col("system") == "dense_flat", 2.0).otherwise(
            F.when(F.col("system") == cells_label(), 0.0).otherwise(1.0)
        )
        runs = runs.withColumn("latency_ms", 1.0 + (F.col("qlabel") * 7) % 11 + offset)
    return stage(runs, "vector_runs")


def _label_grade(highest: int):
    return F.greatest(F.lit(0), F.lit(highest) - F.abs(F.col("qlabel") - F.col("label")))


def vector_qrels(spark: SparkSession, sf_dir: str, runs: DataFrame) -> DataFrame:
    """Pool of the two exact runs, graded by the distance of the labels.

    The pool is shallower than the evaluation depth and leaves out the approximate
    run, so some results stay unjudged.
    """
    pooled = stage(
        pool_candidates(runs.filter(F.col("system") != cells_label()), POOL_DEPTH, POOL_LIMIT),
        "pool",
    )
    labels = embeddings(spark, sf_dir).select("doc_id", "label")
    asked = runs.select("query_id", "qlabel").distinct()
    return (
        pooled.join(labels, "doc_id")
        .join(asked, "query_id")
        .select(
            "query_id", "doc_id", "query", "category",
            _label_grade(3).cast("double").alias("relevance"),
        )
    )


def raw_judgements(spark: SparkSession, sf_dir: str, runs: DataFrame) -> DataFrame:
    """Two graders with faults: blanks, text, a grade off the scale, and
    disagreement on documents that both judged."""
    labels = embeddings(spark, sf_dir).select("doc_id", "label")
    label = F.col("label")
    grade = _label_grade(3).cast("string")
    first = F.when(label == 3, "").when(label == 5, "x").when(label == 7, "5").otherwise(grade)
    second = F.when(label == 8, _label_grade(2).cast("string")).otherwise(grade)
    judged = runs.filter(F.col("system") != cells_label()).join(labels, "doc_id")
    return judged.select(
        "query_id",
        "doc_id",
        F.when(F.col("system") == "dense_flat", first).otherwise(second).alias("relevance"),
    )


def faulty_run(runs: DataFrame) -> DataFrame:
    """Exact run with rank 0, a repeated rank and a repeated document."""
    label, rank = F.col("qlabel"), F.col("rank")
    return runs.filter(F.col("system") == "dense_flat").select(
        "query_id",
        F.when(label == 7, F.lit(0)).otherwise(F.col("doc_id")).cast("long").alias("doc_id"),
        F.when(label == 3, rank - 1)
        .when(label == 5, F.least(rank, F.lit(19)))
        .otherwise(rank)
        .cast("string")
        .alias("rank"),
        "score",
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with country, segment and region as stratum parts."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "n_name", "c_mktsegment", "r_name")
    )
