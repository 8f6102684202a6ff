"""Registered queries: pooling, fusion, validation, metrics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from searchlab.functions.text import PASSAGE_PREFIX, QUERY_PREFIX
from searchlab.operators import checks, evaluate, pool, quantiles
from searchlab.operators.fusion import reciprocal_rank_fusion
from searchlab.plans import experiment, views, views_sql as v
from searchlab.plans.registry import query, rounded
from searchlab.sources.readers import read_run
from searchlab.sources.staging import stage
from searchlab.sources.writers import through_csv

QUALITY = ["ndcg_at_10", "mrr_at_10", "precision_at_10", "recall_at_10"]


def rounded_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# --- pooling and fusion -----------------------------------------------------
@query(
    "union_runs",
    f"WITH {v.VECTOR_RUNS} SELECT system, query_id, category, rank, doc_id, score FROM runs",
)
def union_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = views.vector_runs(spark, sf)
    return runs.select("system", "query_id", "category", "rank", "doc_id", "score")


@query("pool_candidates", f"WITH {v.VECTOR_RUNS} {v.pool('runs', 10, 20)}")
def pool_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return pool.pool_candidates(views.vector_runs(spark, sf))


POOL_SQL = f"""
  SELECT query_id, query, category, p.doc_id, title, company, country, level, summary, skills,
         source_systems, system_count, best_rank, '' AS relevance, '' AS annotator, '' AS notes
  FROM ({v.pool("runs", 10, 20)}) p LEFT JOIN corpus USING (doc_id)"""


def full_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Vector ids meet document ids; ids that only vectors have keep null metadata."""
    candidates = pool.pool_candidates(views.vector_runs(spark, sf))
    metadata = ["title", "company", "country", "level", "summary", "skills"]
    return pool.annotation_pool(candidates, views.corpus(spark, sf), metadata)


@query("annotation_pool", f"WITH {v.VECTOR_RUNS}, {v.CORPUS} {POOL_SQL}")
def annotation_pool(spark: SparkSession, sf: str) -> DataFrame:
    return full_pool(spark, sf)


@query(
    "pool_stats",
    f"""WITH {v.VECTOR_RUNS}
        SELECT min(n) AS min_candidates, round(avg(n), 6) AS mean_candidates,
               max(n) AS max_candidates
        FROM (SELECT query_id, count(*) AS n FROM ({v.pool("runs", 10, 20)}) GROUP BY query_id)""",
)
def pool_stats(spark: SparkSession, sf: str) -> DataFrame:
    candidates = pool.pool_candidates(views.vector_runs(spark, sf))
    return rounded(pool.pool_stats(candidates), "mean_candidates")


FUSED = v.top_k(
    """SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf
       FROM runs GROUP BY ALL""",
    score="rrf",
)


@query("rrf_fusion", f"WITH {v.VECTOR_RUNS} SELECT query_id, rank, doc_id, rrf FROM ({FUSED})")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = reciprocal_rank_fusion(views.vector_runs(spark, sf))
    return rounded(fused.select("query_id", "rank", "doc_id", "rrf"), "rrf")


# --- validation -------------------------------------------------------------
FAULTY = f"{v.VECTOR_RUNS}, {v.FAULTY_RUN}"


@query(
    "run_load",
    f"WITH {FAULTY} SELECT 'loaded' AS system, query_id, doc_id, rank, score FROM faulty_run",
)
def run_load(spark: SparkSession, sf: str) -> DataFrame:
    """The run through CSV and the reader of run files."""
    run = through_csv(views.faulty_run(views.vector_runs(spark, sf)), "run")
    return read_run(spark, run, "loaded").select(
        "system", "query_id", F.col("doc_id").cast("long").alias("doc_id"), "rank", "score"
    )


@query(
    "run_report",
    f"""WITH {FAULTY}
        SELECT 'invalid_rank' AS rule, count(*) AS n FROM faulty_run WHERE rank IS NULL OR rank < 1
        UNION ALL SELECT 'duplicate_document', count(*) FROM
          (SELECT 1 FROM faulty_run GROUP BY query_id, doc_id HAVING count(*) > 1)
        UNION ALL SELECT 'duplicate_rank', count(*) FROM
          (SELECT 1 FROM faulty_run GROUP BY query_id, rank HAVING count(*) > 1)""",
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return checks.run_report(views.faulty_run(views.vector_runs(spark, sf)))


RAW = f"""{v.VECTOR_RUNS}, {v.RAW_JUDGEMENTS},
  graded AS (SELECT *, trim(relevance) = '' AS blank,
                    try_cast(nullif(trim(relevance), '') AS DOUBLE) AS grade
             FROM raw_judgements)"""


@query(
    "qrels_report",
    f"""WITH {RAW}
        SELECT 'unlabelled' AS rule, count(*) FILTER (blank) AS n FROM graded
        UNION ALL SELECT 'not_numeric', count(*) FILTER (grade IS NULL AND NOT blank) FROM graded
        UNION ALL SELECT 'invalid_grade', count(*) FILTER (grade NOT IN (0, 1, 2, 3)) FROM graded
        UNION ALL SELECT 'conflicting_pairs', count(*) FROM (
          SELECT 1 FROM graded GROUP BY query_id, doc_id
          HAVING count(DISTINCT CASE WHEN blank THEN 0 ELSE grade END) > 1)
        UNION ALL SELECT 'empty', (count(*) = 0)::BIGINT FROM graded""",
)
def qrels_report(spark: SparkSession, sf: str) -> DataFrame:
    return checks.qrels_report(views.raw_judgements(spark, sf, views.vector_runs(spark, sf)))


@query(
    "qrels_clean",
    f"""WITH {RAW}
        SELECT query_id, doc_id, min(CASE WHEN blank THEN 0 ELSE grade END) AS relevance
        FROM graded WHERE CASE WHEN blank THEN 0 ELSE grade END IN (0, 1, 2, 3)
        GROUP BY query_id, doc_id""",
)
def qrels_clean(spark: SparkSession, sf: str) -> DataFrame:
    judgements = views.raw_judgements(spark, sf, views.vector_runs(spark, sf))
    return checks.clean_qrels(judgements, allow_incomplete=True)


# --- metrics ----------------------------------------------------------------
def runs_and_qrels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    runs = views.vector_runs(spark, sf, latency=True)
    return runs, stage(views.vector_qrels(spark, sf, runs), "qrels")


def per_query_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics_per_query(*runs_and_qrels(spark, sf))


COVERAGE = "judgement_coverage_at_10"
COUNTS = "retrieved_at_10, judged_at_10"
JUDGED = "judged_documents, relevant_judged_documents"


@query(
    "judgement_coverage",
    f"""WITH {v.EVALUATION}
        SELECT system, query_id, {COUNTS}, {rounded_sql([COVERAGE])}, {JUDGED} FROM per_query""",
)
def judgement_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.judgement_coverage(*runs_and_qrels(spark, sf)), COVERAGE)


@query(
    "ideal_dcg",
    f"WITH {v.EVALUATION} SELECT query_id, round(ideal_dcg, 6) AS ideal_dcg FROM ideal",
)
def ideal_dcg(spark: SparkSession, sf: str) -> DataFrame:
    _, qrels = runs_and_qrels(spark, sf)
    return rounded(evaluate.ideal_dcg(qrels), "ideal_dcg")


@query(
    "metrics_per_query",
    f"""WITH {v.EVALUATION}
        SELECT system, query_id, {COUNTS}, {JUDGED}, query, category, latency_ms,
               {rounded_sql([COVERAGE, *QUALITY])} FROM per_query""",
)
def metrics_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(per_query_metrics(spark, sf), COVERAGE, *QUALITY)


MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in QUALITY)
SYSTEM_SUMMARY = f"""
  SELECT system, count(DISTINCT query_id) AS query_count,
         round(avg({COVERAGE}), 6) AS mean_judgement_coverage_at_k, {MEANS}"""


@query(
    "summary_by_system",
    f"""WITH {v.EVALUATION} {SYSTEM_SUMMARY}, round(avg(latency_ms), 6) AS mean_latency_ms,
          round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms
        FROM per_query GROUP BY system""",
)
def summary_by_system(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        evaluate.summary_by_system(per_query_metrics(spark, sf)),
        "mean_judgement_coverage_at_k", *QUALITY, "mean_latency_ms", "p95_latency_ms",
    )


@query(
    "summary_by_category",
    f"""WITH {v.EVALUATION}
        SELECT system, category, count(DISTINCT query_id) AS query_count, {MEANS}
        FROM per_query WHERE category IS NOT NULL GROUP BY system, category""",
)
def summary_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.summary_by_category(per_query_metrics(spark, sf)), *QUALITY)


@query(
    "coverage_warnings",
    f"""WITH {v.EVALUATION}
        SELECT system, count(*) FILTER ({COVERAGE} < 1) AS incomplete, count(*) AS results
        FROM per_query GROUP BY system""",
)
def coverage_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.coverage_warnings(per_query_metrics(spark, sf))


@query(
    "latency_stats",
    """SELECT event_type, round(avg(value), 6) AS mean_latency_ms, min(value) AS min_latency_ms,
              max(value) AS max_latency_ms,
              round(quantile_cont(value, 0.95), 6) AS p95_latency_ms
       FROM events GROUP BY event_type""",
)
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Event values stand in for measured latencies."""
    events = views.table(spark, sf, "events")
    stats = quantiles.latency_stats(events, "event_type", "value")
    return rounded(stats, "mean_latency_ms", "p95_latency_ms")


# --- the whole experiment ---------------------------------------------------
TEXT_RUNS = f"""{v.BM25_ALL},
{v.encoded("docs", "corpus", "doc_id",
           "title || chr(10) || skills || chr(10) || summary", PASSAGE_PREFIX)},
{v.encoded("asked", "queries", "query_id", "query", QUERY_PREFIX)},
flat_scores AS ({v.dense_from_buckets("docs", "asked")}),
flat AS ({v.top_k("SELECT * FROM flat_scores")}),
pivots AS (SELECT doc_id AS cell FROM documents ORDER BY {v.hashed("doc_id")} LIMIT {experiment.CELLS}),
pivot_docs AS (SELECT * FROM docs WHERE doc_id IN (SELECT cell FROM pivots)),
doc_queries AS (SELECT doc_id AS query_id, bucket, weight FROM docs),
doc_cells AS (
  SELECT query_id AS doc_id, doc_id AS cell
  FROM ({v.dense_from_buckets("pivot_docs", "doc_queries")})
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {v.significant("score")} DESC, doc_id) = 1),
visits AS (
  SELECT query_id, doc_id AS cell FROM ({v.dense_from_buckets("pivot_docs", "asked")})
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {v.significant("score")} DESC, doc_id)
          <= {experiment.PROBES}),
ivf AS ({v.top_k('''SELECT query_id, doc_id, score FROM flat_scores
                    JOIN doc_cells USING (doc_id) JOIN visits USING (query_id, cell)''')}),
runs AS (
  SELECT r.*, query, category, NULL::DOUBLE AS latency_ms FROM (
    SELECT query_id, doc_id, rank, 'bm25' AS system FROM bm25
    UNION ALL SELECT query_id, doc_id, rank, 'dense_flat' FROM flat
    UNION ALL SELECT query_id, doc_id, rank, 'ivf' FROM ivf) r
  JOIN queries USING (query_id)),
text_pool AS ({v.pool("(SELECT * FROM runs WHERE system <> 'ivf')", 10, 20)}),
qrels AS (
  SELECT query_id, doc_id, query, category,
         CASE WHEN held / tokens >= 0.9 THEN 3.0 WHEN held / tokens >= 0.5 THEN 2.0
              WHEN held / tokens >= 0.25 THEN 1.0 ELSE 0.0 END::DOUBLE AS relevance
  FROM (SELECT p.query_id, p.doc_id, p.query, p.category, count(x.term) AS held,
               count(*) AS tokens
        FROM text_pool p JOIN query_terms q ON q.query_id = p.query_id
        LEFT JOIN postings x ON x.doc_id = p.doc_id AND x.term = q.term GROUP BY ALL))"""


@query(
    "evaluation_end_to_end",
    f"WITH {TEXT_RUNS}, {v.metrics()} {SYSTEM_SUMMARY} FROM per_query GROUP BY system",
)
def evaluation_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    summary = experiment.run_experiment(views.corpus(spark, sf), views.queries(spark, sf))
    return rounded(summary, "mean_judgement_coverage_at_k", *QUALITY)
