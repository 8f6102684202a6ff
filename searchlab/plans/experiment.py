"""The whole experiment: corpus and queries -> runs -> pool -> grades -> metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from searchlab.functions.text import PASSAGE_PREFIX, QUERY_PREFIX
from searchlab.operators import ann, lexical
from searchlab.operators.dense import exact_top_k
from searchlab.operators.encode import encode_texts
from searchlab.operators.evaluate import metrics_per_query, summary_by_system
from searchlab.operators.pool import pool_candidates, union_runs
from searchlab.sources.staging import stage

CELLS = 16
PROBES = 4


def text_runs(corpus: DataFrame, queries: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Lexical, exact and approximate run over one corpus; also the postings.

    ``corpus(doc_id, title, skills, summary)``, ``queries(query_id, query, category)``.
    """
    index = lexical.write_index(corpus)
    body = F.concat_ws("\n", "title", "skills", "summary")
    vectors = stage(encode_texts(corpus, ["doc_id"], body, PASSAGE_PREFIX), "doc_vectors")
    asked = stage(
        encode_texts(queries, ["query_id"], F.col("query"), QUERY_PREFIX, vec_col="qvec"),
        "query_vectors",
    )
    pivots = stage(ann.pivot_centroids(vectors, CELLS), "centroids")
    assigned = ann.assign_cells(vectors, pivots)
    runs = union_runs(
        {
            "bm25": lexical.search_bm25(index, queries, k),
            "dense_flat": exact_top_k(vectors, asked, k),
            "ivf": ann.search_cells(assigned, asked, pivots, [PROBES], k).drop("nprobe"),
        }
    )
    return stage(runs.join(queries, "query_id"), "text_runs"), index.postings


def overlap_grades(pool: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Grade of a pooled document: share of the query's distinct tokens it holds.

    Stands in for the graders: 3 from nine tenths, 2 from a half, 1 from a quarter.
    """
    wanted = lexical.query_terms(queries).select("query_id", "term")
    pairs = pool.select("query_id", "doc_id")
    held = (
        postings.select("doc_id", "term")
        .join(pairs, "doc_id")
        .join(wanted, ["query_id", "term"])
        .groupBy("query_id", "doc_id")
        .agg(F.count("*").alias("held"))
    )
    size = wanted.groupBy("query_id").agg(F.count("*").alias("tokens"))
    share = F.coalesce(F.col("held"), F.lit(0)) / F.col("tokens")
    grade = F.when(share >= 0.9, 3.0).when(share >= 0.5, 2.0).when(share >= 0.25, 1.0)
    return (
        pool.join(size, "query_id")
        .join(held, ["query_id", "doc_id"], "left")
        .select("query_id", "doc_id", "query", "category", grade.otherwise(0.0).alias("relevance"))
    )


def run_experiment(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Metrics per system; the approximate run is not pooled."""
    runs, postings = text_runs(corpus, queries)
    pool = stage(pool_candidates(runs.filter(F.col("system") != "ivf")), "pool")
    qrels = stage(overlap_grades(pool, queries, postings), "qrels")
    return summary_by_system(metrics_per_query(runs, qrels, k), k)
