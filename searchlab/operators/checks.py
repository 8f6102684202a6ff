"""Validation: reports of violations as jobs, and helpers that raise."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

GRADES = (0.0, 1.0, 2.0, 3.0)


def require_columns(df: DataFrame, required: list[str], name: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")


def raise_violations(report: DataFrame, name: str) -> None:
    """Raise when any rule of a ``(rule, n)`` report was broken."""
    broken = [f"{r['rule']}: {r['n']}" for r in report.filter(F.col("n") > 0).collect()]
    if broken:
        raise ValueError(f"{name}: " + ", ".join(sorted(broken)))


def _rules(one_row: DataFrame) -> DataFrame:
    return one_row.unpivot([], one_row.columns, "rule", "n")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; counted before the shuffle."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def _grade_columns(qrels: DataFrame) -> DataFrame:
    raw = F.col("relevance").cast("string")
    return qrels.withColumn("_blank", raw.isNull() | (F.trim(raw) == "")).withColumn(
        "_grade", F.trim(raw).try_cast("double")
    )


def qrels_report(qrels: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """``(rule, n)``: blank, non-numeric, out of scale, conflicting or no judgements."""
    graded = _grade_columns(qrels)
    blank, grade = F.col("_blank"), F.col("_grade")
    # A blank counts as grade 0 when it meets another grade of the same pair.
    effective = F.when(blank, 0.0).otherwise(grade)
    pairs = graded.groupBy("query_id", doc_col).agg(
        F.count("*").alias("rows"),
        F.count_if(blank).alias("blank"),
        F.count_if(grade.isNull() & ~blank).alias("malformed"),
        F.count_if(grade.isNotNull() & ~grade.isin(*GRADES)).alias("off_scale"),
        F.count_if(grade.isNull() & ~blank).alias("unknown"),
        F.min(effective).alias("lowest"),
        F.max(effective).alias("highest"),
    )
    return _rules(
        pairs.agg(
            F.coalesce(F.sum("blank"), F.lit(0)).alias("unlabelled"),
            F.coalesce(F.sum("malformed"), F.lit(0)).alias("not_numeric"),
            F.coalesce(F.sum("off_scale"), F.lit(0)).alias("invalid_grade"),
            F.count_if(F.col("lowest") != F.col("highest")).alias("conflicting_pairs"),
            F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("empty"),
        )
    )


def clean_qrels(
    qrels: DataFrame, doc_col: str = "doc_id", allow_incomplete: bool = False
) -> DataFrame:
    """Numeric grades, one row per pair; a blank is grade 0 and judged if allowed.

    Grades that are not numeric or off the scale are left out here; call
    ``raise_violations(qrels_report(..))`` first to refuse them.
    """
    graded = _grade_columns(qrels)
    if allow_incomplete:
        grade = F.when(F.col("_blank"), 0.0).otherwise(F.col("_grade"))
    else:
        grade = F.col("_grade")
    metadata = [F.min(c).alias(c) for c in ("query", "category") if c in qrels.columns]
    return (
        graded.withColumn("_grade", grade)
        .filter(F.col("_grade").isin(*GRADES))
        .groupBy("query_id", doc_col)
        .agg(*metadata, F.min("_grade").alias("relevance"))
    )


def run_report(run: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """``(rule, n)``: bad ranks, documents or ranks repeated within a query."""
    rank = F.col("rank").cast("string").try_cast("double")
    bad = run.agg(F.count_if(rank.isNull() | F.isnan(rank) | (rank < 1)).alias("n"))
    checks = {
        "invalid_rank": bad,
        "duplicate_document": duplicate_keys(run, ["query_id", doc_col]).agg(
            F.count("*").alias("n")
        ),
        "duplicate_rank": duplicate_keys(
            run.withColumn("rank", rank), ["query_id", "rank"]
        ).agg(F.count("*").alias("n")),
    }
    return _named(checks)


def _named(checks: dict[str, DataFrame]) -> DataFrame:
    reports = [df.select(F.lit(rule).alias("rule"), "n") for rule, df in checks.items()]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionAll(report)
    return result


def join_cardinality_report(
    left: DataFrame, right: DataFrame, key: list[str], one_to_one: bool = True
) -> DataFrame:
    """Keys that break the promised uniqueness of a join."""

    def repeated(df: DataFrame) -> DataFrame:
        return duplicate_keys(df, key).agg(F.count("*").alias("n"))

    checks = {"right_key_not_unique": repeated(right)}
    if one_to_one:
        checks = {"left_key_not_unique": repeated(left), **checks}
    return _named(checks)


def vector_report(
    vectors: DataFrame,
    corpus_keys: DataFrame,
    dimension: int,
    id_col: str = "doc_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Missing or wrong vectors, repeated ids, and ids that vectors and corpus do not share.

    Elements must be single precision: otherwise every row is reported.
    """
    width = F.size(vec_col)
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    shape = vectors.agg(
        F.count_if(F.col(vec_col).isNull()).alias("null_vector"),
        F.count_if(width != dimension).alias("wrong_dimension"),
        F.count_if(F.exists(vec_col, lambda x: x.isNull() | F.isnan(x))).alias("not_a_number"),
        F.count_if(F.lit(not single)).alias("wrong_element_type"),
    )
    ids, keys = vectors.select(id_col), corpus_keys.select(id_col)
    return _rules(shape).unionAll(
        _named(
            {
                "repeated_id": duplicate_keys(ids, [id_col]).agg(F.count("*").alias("n")),
                "vector_without_document": ids.join(keys, id_col, "left_anti").agg(
                    F.count("*").alias("n")
                ),
                "document_without_vector": keys.join(ids, id_col, "left_anti").agg(
                    F.count("*").alias("n")
                ),
            }
        )
    )


HASH_DIGITS = 12  # hexadecimal ones of a row's hash


def content_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """The same for the same rows in any order and partitioning: rows, and the sum of their hashes.

    Nulls differ from empty texts; arrays count by their printed form.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, HASH_DIGITS)
    total = F.sum(F.conv(digest, 16, 10).cast("decimal(20,0)"))
    rows, sum_ = df.agg(F.count("*"), F.coalesce(total, F.lit(0))).first()
    return f"{rows}:{int(sum_)}"


def stale_facts(stored: dict, expected: dict) -> dict[str, tuple]:
    """What an artefact was made from and what is there now, where both differ."""
    return {k: (stored.get(k), v) for k, v in expected.items() if stored.get(k) != v}


def stale_artefact_report(spark: SparkSession, location: str, **expected) -> DataFrame:
    """``(fact, stored, expected)`` of every fact that differs; a missing manifest has stored none."""
    stale = stale_facts(stored_facts(spark, location) or {}, expected)
    rows = [(k, None if a is None else str(a), str(b)) for k, (a, b) in sorted(stale.items())]
    return spark.createDataFrame(rows, "fact string, stored string, expected string")


def write_manifest(spark: SparkSession, location: str, **facts) -> None:
    """Facts about a saved artefact next to it."""
    record = json.dumps(facts, sort_keys=True)
    table = spark.createDataFrame([(record,)], "manifest string").coalesce(1)
    table.write.mode("overwrite").text(f"{location}.manifest")


def stored_facts(spark: SparkSession, location: str) -> dict | None:
    """Facts of a saved artefact; None when there is none."""
    try:
        return json.loads(spark.read.text(f"{location}.manifest").first()[0])
    except AnalysisException:
        return None


def reusable(spark: SparkSession, location: str, rebuild: bool = False, **expected) -> bool:
    """Whether the artefact is there and fits; one made from something else raises."""
    stored = None if rebuild else stored_facts(spark, location)
    if stored is None:
        return False
    stale = stale_facts(stored, expected)
    if stale:
        raise ValueError(f"stale artefact at {location}, rebuild it: {stale}")
    return True
