"""The steps of an experiment as jobs from files to files.

Every step reads what an earlier one wrote. Saved artefacts carry a manifest; one
made from another corpus is refused, a fitting one is reused unless ``rebuild``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from searchlab.functions.text import PASSAGE_PREFIX, QUERY_PREFIX
from searchlab.operators import ann, checks, evaluate, lexical, pool, profile, reduction
from searchlab.operators.dense import exact_top_k
from searchlab.operators.encode import HashedEncoder, encode_texts
from searchlab.operators.quantiles import latency_stats
from searchlab.plans.corpus_build import build_corpus
from searchlab.sources import readers, writers
from searchlab.sources.staging import stage

Encoder = Callable[[], object]

FIELDS = {"job_title": 3.0, "job_skills": 2.0, "job_summary": 1.0}
RUN_METADATA = [
    "job_title", "company", "job_location", "job_level", "job_type", "job_skills",
]
POOL_METADATA = [
    "job_title", "company", "job_location", "job_level", "job_type", "job_summary", "job_skills",
]


def build_corpus_file(
    spark: SparkSession,
    postings: str,
    summaries: str,
    skills: str,
    output: str,
    sample_size: int,
    final_size: int | None = None,
) -> DataFrame:
    """Raw CSV files -> corpus."""
    corpus = build_corpus(
        readers.read_postings(spark, postings),
        readers.read_text_table(spark, summaries, "job_summary"),
        readers.read_text_table(spark, skills, "job_skills"),
        sample_size,
        final_size,
    )
    writers.write_corpus(corpus, output)
    return spark.read.parquet(output)


def _save_run(
    spark: SparkSession, found: DataFrame, asked: DataFrame, corpus: str, system: str, output: str
) -> DataFrame:
    """Ranked lists with query and document columns, as CSV."""
    found = stage(found, "found")
    documents = readers.read_corpus(spark, corpus, ["doc_id", *RUN_METADATA])
    run = documents.join(found, "doc_id").join(asked, "query_id")
    run = run.withColumn("system", F.lit(system)).select(
        "query_id", "query", "category", "system", "rank", "doc_id", "score", *RUN_METADATA
    )
    run = stage(run, "run")
    writers.write_run(run, output, as_csv=True)
    return run


def lexical_run(
    spark: SparkSession,
    corpus: str,
    queries: str,
    index: str,
    output: str,
    k: int = 20,
    rebuild: bool = False,
) -> DataFrame:
    """Build or reuse the inverted index, search all queries."""
    asked = readers.read_queries(spark, queries)
    lexical.require_searchable(asked)
    documents = readers.read_corpus(spark, corpus, ["doc_id", *FIELDS])
    facts = {"content": checks.content_fingerprint(documents, ["doc_id", *FIELDS]), "weights": FIELDS}
    if checks.reusable(spark, index, rebuild, **facts):
        built = lexical.read_index(spark, index)
    else:
        built = lexical.write_index(documents, index, fields=FIELDS)
        checks.write_manifest(spark, index, **facts)
    return _save_run(spark, lexical.search_bm25(built, asked, k), asked, corpus, "bm25", output)


def encode_corpus(
    spark: SparkSession,
    corpus: str,
    output: str,
    encoder: Encoder = HashedEncoder,
    rebuild: bool = False,
) -> DataFrame:
    """Vectors of all documents, keyed by ``doc_id``."""
    documents = readers.read_corpus(spark, corpus, ["doc_id", "search_text"])
    facts = {"documents": documents.count(), "dimension": encoder().dimension}
    if not checks.reusable(spark, output, rebuild, **facts):
        vectors = encode_texts(
            documents, ["doc_id"], F.col("search_text"), PASSAGE_PREFIX, encoder
        ).withColumn("embedding", F.col("embedding").cast("array<float>"))
        writers.write_vectors(vectors, output)
        checks.write_manifest(spark, output, **facts)
    vectors = readers.read_vectors(spark, output)
    report = checks.vector_report(vectors, documents, facts["dimension"])
    checks.raise_violations(report, "vectors")
    return vectors


def _encoded_queries(spark: SparkSession, queries: str, encoder: Encoder) -> tuple:
    asked = readers.read_queries(spark, queries)
    vectors = encode_texts(
        asked, ["query_id"], F.col("query"), QUERY_PREFIX, encoder, vec_col="qvec"
    )
    return asked, stage(vectors, "query_vectors")


def _write_record(vectors: DataFrame, asked: DataFrame, system: str, k: int, output: str) -> None:
    """One JSON row: system, documents, dimension, queries and depth of a vector run."""
    record = vectors.agg(
        F.lit(system).alias("system"),
        F.count("*").alias("documents"),
        F.max(F.size("embedding")).alias("dimension"),
        F.lit(asked.count()).alias("query_count"),
        F.lit(k).alias("top_k"),
    )
    writers.write_metrics_json(record, output)


def dense_run(
    spark: SparkSession,
    corpus: str,
    queries: str,
    vectors: str,
    output: str,
    encoder: Encoder = HashedEncoder,
    k: int = 20,
    system: str = "dense_flat",
    metrics: str | None = None,
) -> DataFrame:
    """Exact search of all queries; ``metrics``: where the record of the run goes."""
    asked, encoded = _encoded_queries(spark, queries, encoder)
    documents = readers.read_vectors(spark, vectors)
    if metrics:
        _write_record(documents, asked, system, k, metrics)
    found = exact_top_k(documents, encoded, k)
    return _save_run(spark, found, asked, corpus, system, output)


def cell_runs(
    spark: SparkSession,
    corpus: str,
    queries: str,
    vectors: str,
    cells: str,
    output: str,
    metrics: str,
    probes: list[int],
    cell_count: int = 256,
    encoder: Encoder = HashedEncoder,
    k: int = 20,
    recall_k: int = 10,
    rebuild: bool = False,
) -> DataFrame:
    """Build or reuse the cells, then one run per ``nprobe`` and its recall.

    The run of a setting lies in the folder ``system=<name>`` of ``output``; that path is
    what the pool and the evaluation take.
    """
    asked, encoded = _encoded_queries(spark, queries, encoder)
    documents = readers.read_vectors(spark, vectors)
    rows, dimension = documents.agg(F.count("*"), F.max(F.size("embedding"))).first()
    facts = {"documents": rows, "dimension": dimension, "cells": cell_count}
    if not checks.reusable(spark, cells, rebuild, **facts):
        centers = stage(ann.kmeans_centroids(documents, cell_count), "centers")
        writers.write_vectors(centers, f"{cells}.centroids")
        ann.write_cells(ann.assign_cells(documents, centers), cells)
        checks.write_manifest(spark, cells, **facts)
    centers = spark.read.parquet(f"{cells}.centroids")
    found = stage(
        ann.search_cells(ann.read_cells(spark, cells), encoded, centers, probes, k), "found"
    )
    exact = stage(exact_top_k(documents, encoded, k), "exact")
    name = F.format_string(f"ivf_c{cell_count}_p%d", "nprobe")
    run = (
        readers.read_corpus(spark, corpus, ["doc_id", *RUN_METADATA])
        .join(found.withColumn("system", name).drop("nprobe"), "doc_id")
        .join(asked, "query_id")
    )
    writers.write_run(run, output)
    recall = ann.recall_against_exact(exact, found, recall_k).select(
        name.alias("system"),
        F.lit(facts["documents"]).alias("documents"),
        F.lit(cell_count).alias("cells"),
        "nprobe",
        f"ann_recall_at_{recall_k}",
    )
    writers.write_metrics_json(recall, metrics)
    return recall


def reduce_vectors(
    spark: SparkSession,
    vectors: str,
    output: str,
    model: str,
    metrics: str,
    dimensions: list[int],
    sample_size: int | None = None,
) -> DataFrame:
    """Fit once at the largest dimension, write all dimensions and both reports."""
    documents = readers.read_vectors(spark, vectors)
    projection, rows = reduction.fit_pca(documents, max(dimensions), sample_size)
    reduction.save_projection(spark, projection, model)
    reduced = reduction.project_dimensions(documents, projection, dimensions)
    writers.write_vectors(
        reduced.withColumn("embedding", F.col("embedding").cast("array<float>")), output, "dim"
    )
    variance = reduction.explained_variance(spark, projection)
    writers.write_table(variance, f"{metrics}/explained_variance", ["component"])
    report = reduction.reduction_report(documents, dimensions, projection=projection)
    report = stage(report.withColumn("pca_sample_size", F.lit(rows)), "report")
    writers.write_table(report, f"{metrics}/reduction", ["output_dimension"])
    return report


def reduced_dense_run(
    spark: SparkSession,
    corpus: str,
    queries: str,
    reduced: str,
    model: str,
    output: str,
    dimension: int,
    encoder: Encoder = HashedEncoder,
    k: int = 20,
    metrics: str | None = None,
) -> DataFrame:
    """Exact search on reduced vectors; queries pass through the same projection."""
    asked, encoded = _encoded_queries(spark, queries, encoder)
    projection = reduction.load_projection(spark, model)
    small = stage(reduction.project(encoded, projection, dimension, "qvec"), "reduced_queries")
    documents = spark.read.parquet(reduced).filter(F.col("dim") == dimension)
    if documents.isEmpty():
        raise ValueError(f"no vectors of {dimension} dimensions at {reduced}")
    if metrics:
        _write_record(documents, asked, f"dense_pca{dimension}", k, metrics)
    found = exact_top_k(documents, small, k)
    return _save_run(spark, found, asked, corpus, f"dense_pca{dimension}", output)


def annotation_pool_file(
    spark: SparkSession,
    runs: dict[str, str],
    corpus: str,
    output: str,
    source_top_k: int = 10,
    max_candidates: int = 20,
) -> DataFrame:
    """Runs by system name -> documents to grade."""
    loaded = {}
    for name, path in runs.items():
        loaded[name] = readers.read_run(spark, path, name)
        checks.require_columns(loaded[name], ["query", "category"], f"run {name!r}")
    columns = ["query_id", "query", "category", "doc_id", "rank"]
    union = pool.union_runs({name: run.select(*columns) for name, run in loaded.items()})
    documents = readers.read_corpus(spark, corpus, ["doc_id", *POOL_METADATA])
    candidates = pool.pool_candidates(union, source_top_k, max_candidates)
    pooled = stage(pool.annotation_pool(candidates, documents, POOL_METADATA), "pool")
    writers.write_pool(pooled, output)
    return pooled


def evaluate_files(
    spark: SparkSession,
    qrels: str,
    runs: dict[str, str],
    output: str,
    k: int = evaluate.DEFAULT_K,
    threshold: float = evaluate.DEFAULT_THRESHOLD,
    allow_incomplete: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary, per-query and per-category metrics; faulty input is refused."""
    if not runs:
        raise ValueError("at least one run is required")
    raw = readers.read_qrels(spark, qrels)
    report = checks.qrels_report(raw)
    if allow_incomplete:
        report = report.filter(F.col("rule") != "unlabelled")
    checks.raise_violations(report, "judgements")
    judged = stage(checks.clean_qrels(raw, allow_incomplete=allow_incomplete), "judgements")
    loaded = {name: readers.read_run(spark, path, name) for name, path in runs.items()}
    for name, run in loaded.items():
        checks.raise_violations(checks.run_report(run), f"run {name!r}")
    wanted = ["query_id", "doc_id", "rank", "latency_ms"]
    union = pool.union_runs(
        {name: run.select(*[c for c in wanted if c in run.columns]) for name, run in loaded.items()}
    )
    per_query = stage(
        evaluate.metrics_per_query(union, judged, k, threshold, systems=list(runs)), "per_query"
    )
    summary = evaluate.summary_by_system(per_query, k)
    by_category = evaluate.summary_by_category(per_query, k)
    writers.write_evaluation(per_query, summary, by_category, output, k)
    return summary, per_query, by_category


def search_metrics(run: DataFrame, output: str, k: int = 20) -> DataFrame:
    """Record of a run that carries measured latencies."""
    record = writers.run_metrics(run, latency_stats(run), k)
    writers.write_metrics_json(record, output)
    return record


def profile_corpus(spark: SparkSession, corpus: str, top: int = 20) -> dict[str, DataFrame]:
    """Tables of the corpus profile by name."""
    documents = spark.read.parquet(corpus)
    return {
        "nulls": profile.null_counts(documents),
        "countries": profile.value_counts(documents, "search_country", top),
        "levels": profile.value_counts(documents, "job_level"),
        "types": profile.value_counts(documents, "job_type"),
        "titles": profile.value_counts(documents, "job_title", top),
        "companies": profile.value_counts(documents, "company", top),
        "country_shares": profile.value_shares(documents, "search_country"),
        "distinct": profile.distinct_counts(documents, ["search_country", "company", "job_title"]),
        "lengths": profile.length_describe(documents, "search_text"),
        "length_histogram": profile.length_histogram(documents, "search_text"),
    }
