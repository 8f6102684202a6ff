"""Registered queries: every sink, written and read back, reports in the order of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from searchlab.operators import evaluate, quantiles, reduction
from searchlab.plans import views, views_sql as v
from searchlab.plans.catalog_evaluation import COVERAGE, QUALITY, full_pool, per_query_metrics
from searchlab.plans.catalog_search import label_basis
from searchlab.plans.registry import query, rounded
from searchlab.sources import writers
from searchlab.sources.staging import new_location


def lines(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns of a written report, with ``place``: the line's place in the whole report.

    Files of a sorted write are named in order; a report's file is one split, whose rows keep their order.
    """
    raw = spark.read.csv(path, header=True)
    rows = raw.select(
        *[F.col(c).try_cast(kind).alias(c) for c, kind in columns.items()],
        F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_line"),
    )
    in_order = Window.orderBy("_file", "_line")  # a report is small
    return rows.withColumn("place", F.row_number().over(in_order).cast("long")).drop("_file", "_line")


@query("sink_corpus", f"WITH {v.CORPUS} SELECT * FROM corpus")
def sink_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = new_location(spark, "corpus")
    writers.write_corpus(views.corpus(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "sink_run",
    f"""WITH {v.VECTOR_RUNS}
        SELECT system, query_id, doc_id, rank, round(score, 6) AS score,
               row_number() OVER (ORDER BY system, query_id, rank) AS place FROM runs""",
)
def sink_run(spark: SparkSession, sf: str) -> DataFrame:
    path = new_location(spark, "run_csv")
    writers.write_run(views.vector_runs(spark, sf), path, as_csv=True)
    return lines(
        spark, path, {"system": "string", "query_id": "string", "doc_id": "bigint", "rank": "bigint", "score": "double"}
    )


@query(
    "sink_run_by_system",
    f"WITH {v.VECTOR_RUNS} SELECT system, query_id, doc_id, rank, round(score, 6) AS score FROM runs",
)
def sink_run_by_system(spark: SparkSession, sf: str) -> DataFrame:
    path = new_location(spark, "run")
    writers.write_run(views.vector_runs(spark, sf), path)
    return spark.read.parquet(path).select("system", "query_id", "doc_id", "rank", "score")


@query(
    "sink_metrics_json",
    f"""WITH {v.VECTOR_RUNS}
        SELECT system, count(DISTINCT query_id) AS query_count, 20::BIGINT AS top_k,
               round(avg(latency_ms), 6) AS mean_latency_ms, min(latency_ms) AS min_latency_ms,
               max(latency_ms) AS max_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms
        FROM runs GROUP BY system""",
)
def sink_metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    runs, path = views.vector_runs(spark, sf, latency=True), new_location(spark, "metrics")
    writers.write_metrics_json(writers.run_metrics(runs, quantiles.latency_stats(runs), 20), path)
    figures = [f"{name}_latency_ms" for name in ("mean", "min", "max", "p95")]
    schema = "system string, query_count long, top_k long, " + ", ".join(f"{c} double" for c in figures)
    return rounded(spark.read.schema(schema).json(path), *figures)


@query(
    "sink_evaluation",
    f"""WITH {v.EVALUATION},
        scored AS (SELECT system, query_id, category, round(ndcg_at_10, 6) AS ndcg_at_10 FROM per_query),
        by_system AS (SELECT system, round(avg(ndcg_at_10), 6) AS ndcg_at_10 FROM per_query GROUP BY system),
        by_category AS (SELECT system, category, round(avg(ndcg_at_10), 6) AS ndcg_at_10
                        FROM per_query WHERE category IS NOT NULL GROUP BY ALL)
        SELECT 'per_query' AS report, system, query_id, category, ndcg_at_10,
               row_number() OVER (ORDER BY system, query_id) AS place FROM scored
        UNION ALL SELECT 'summary', system, NULL, NULL, ndcg_at_10,
               row_number() OVER (ORDER BY ndcg_at_10 DESC, system) FROM by_system
        UNION ALL SELECT 'category', system, NULL, category, ndcg_at_10,
               row_number() OVER (ORDER BY category, ndcg_at_10 DESC, system) FROM by_category""",
)
def sink_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """The three reports of an evaluation, each line with its place."""
    per_query, path = per_query_metrics(spark, sf), new_location(spark, "evaluation")
    writers.write_evaluation(
        rounded(per_query, COVERAGE, *QUALITY),
        rounded(evaluate.summary_by_system(per_query), *QUALITY),
        rounded(evaluate.summary_by_category(per_query), *QUALITY),
        path,
    )
    named = {"system": "string", "ndcg_at_10": "double"}
    per_line = lines(spark, f"{path}/per_query_metrics", named | {"query_id": "string", "category": "string"})
    summary = lines(spark, f"{path}/summary_metrics", named)
    by_category = lines(spark, f"{path}/category_metrics", named | {"category": "string"})
    none = F.lit(None).cast("string")
    reports = {
        "per_query": per_line, "summary": summary.withColumns({"query_id": none, "category": none}),
        "category": by_category.withColumn("query_id", none),
    }
    columns = ["system", "query_id", "category", "ndcg_at_10", "place"]
    parts = [df.select(F.lit(name).alias("report"), *columns) for name, df in reports.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "sink_pool",
    f"""WITH {v.VECTOR_RUNS}
        SELECT query_id, doc_id, source_systems, system_count, best_rank,
               row_number() OVER (ORDER BY query_id, best_rank, doc_id) AS place
        FROM ({v.pool("runs", 10, 20)})""",
)
def sink_pool(spark: SparkSession, sf: str) -> DataFrame:
    path = new_location(spark, "pool")
    writers.write_pool(full_pool(spark, sf), path)
    return lines(
        spark, path,
        {"query_id": "string", "doc_id": "bigint", "source_systems": "string", "system_count": "bigint", "best_rank": "bigint"},
    )


@query(
    "sink_reduced_vectors",
    f"""WITH {v.VECTORS}, {v.LABEL_MEANS}, {v.VEC_QUERIES}, {v.BASIS},
        wide AS (SELECT doc_id, {v.reduced("embedding")} AS whole FROM vectors, center, basis),
        cut AS (SELECT doc_id, dim, {v.unit("part")} AS small
                FROM (SELECT doc_id, dim, whole[1:dim] AS part
                      FROM wide, (SELECT unnest([2, 4, {views.REDUCED}]) AS dim)))
        SELECT doc_id, dim, len(small) AS dimension, round(list_sum(small), 6) + 0.0 AS total FROM cut""",
)
def sink_reduced_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One folder for each dimension."""
    vectors, path = views.embeddings(spark, sf).select("doc_id", "embedding"), new_location(spark, "reduced")
    small = reduction.project_dimensions(vectors, label_basis(spark, sf), [2, 4, views.REDUCED])
    writers.write_vectors(small, path, partition_by="dim")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select(
        "doc_id", "dim", F.size("embedding").cast("long").alias("dimension"), (F.round(total, 6) + 0.0).alias("total")
    )


@query(
    "scan_fitted_model",
    f"""WITH {v.VECTORS}, {v.LABEL_MEANS}, {v.VEC_QUERIES}, {v.BASIS},
        rows AS (SELECT 0 AS component, mean AS vector FROM center
                 UNION ALL SELECT generate_subscripts(axes, 1), unnest(axes) FROM basis)
        SELECT component::BIGINT AS component, generate_subscripts(vector, 1) - 1 AS axis,
               round(unnest(vector), 6) + 0.0 AS value FROM rows""",
)
def scan_fitted_model(spark: SparkSession, sf: str) -> DataFrame:
    """A projection saved and loaded; component 0 is its mean."""
    path = new_location(spark, "model")
    reduction.save_projection(spark, label_basis(spark, sf), path)
    model = reduction.load_projection(spark, path)
    rows = [(0, model.mean.tolist()), *((i, c.tolist()) for i, c in enumerate(model.components, start=1))]
    return spark.createDataFrame(rows, "component long, vector array<double>").select(
        "component", F.posexplode("vector").alias("axis", "value")
    ).select("component", F.col("axis").cast("long").alias("axis"), (F.round("value", 6) + 0.0).alias("value"))
