"""Scans of raw tables, queries, runs, judgements and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from searchlab.operators.checks import require_columns

# --- fixed values -----------------------------------------------------------
POSTING_COLUMNS = [
    "job_link",
    "job_title",
    "company",
    "job_location",
    "search_city",
    "search_country",
    "search_position",
    "job_level",
    "job_type",
]
# Tokens that mean "missing" in the raw files.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# ----------------------------------------------------------------------------


def _or_null(column: str) -> Column:
    text = F.col(column).cast("string")
    return F.when(~text.isin(MISSING_TOKENS), text).alias(column)


def is_parquet(path: str) -> bool:
    """``*.parquet``, or the folder of one system that ``write_run`` makes (``.../system=name``)."""
    return path.rstrip("/").endswith(".parquet") or "/system=" in path


def read_strings(
    spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV or Parquet (see ``is_parquet``) as strings, missing tokens as null, only the asked columns.

    Types of CSV are never inferred. With ``multi_line`` a quoted field may hold line
    breaks, but then Spark reads a file in one task: store large raw files as
    several files, or convert them to Parquet once and go on from there.
    """
    if is_parquet(path):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.csv(
            path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"'
        )
    wanted = columns or raw.columns
    require_columns(raw, wanted, path)
    return raw.select(*[_or_null(c) for c in wanted])


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return read_strings(spark, path, POSTING_COLUMNS)


def read_text_table(spark: SparkSession, path: str, text_column: str) -> DataFrame:
    return read_strings(spark, path, ["job_link", text_column])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_strings(spark, path, ["query_id", "query", "category"])


def read_corpus(
    spark: SparkSession, path: str, columns: list[str], first: int | None = None
) -> DataFrame:
    """Asked columns with nulls as ``''``; optionally the first documents by id."""
    corpus = spark.read.parquet(path)
    require_columns(corpus, columns, path)
    return first_documents(corpus.select(*columns).fillna(""), first)


def first_documents(corpus: DataFrame, first: int | None, id_col: str = "doc_id") -> DataFrame:
    return corpus if first is None else corpus.orderBy(id_col).limit(first)


def read_run(spark: SparkSession, path: str, system: str) -> DataFrame:
    """Ranked list; ids as strings, numbers typed, the label replaces the file's."""
    return typed_run(read_strings(spark, path), system)


def typed_run(run: DataFrame, system: str, doc_col: str = "doc_id") -> DataFrame:
    require_columns(run, ["query_id", doc_col, "rank"], f"run {system!r}")
    # A rank with a fraction is no rank: null, which the checks report, instead of cut off.
    rank = F.col("rank").cast("string").try_cast("double")
    run = run.withColumn("rank", F.when(rank == F.floor(rank), rank.try_cast("long")))
    for number in ("score", "latency_ms"):
        if number in run.columns:
            run = run.withColumn(number, F.col(number).cast("string").try_cast("double"))
    return run.withColumn("query_id", F.col("query_id").cast("string")).withColumn(
        "system", F.lit(system)
    )


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements as strings; ``checks`` validates and converts the grades."""
    qrels = read_strings(spark, path)
    require_columns(qrels, ["query_id", "doc_id", "relevance"], path)
    return qrels


def read_vectors(
    spark: SparkSession, path: str, id_col: str = "doc_id", vec_col: str = "embedding"
) -> DataFrame:
    vectors = spark.read.parquet(path)
    require_columns(vectors, [id_col, vec_col], path)
    return vectors
