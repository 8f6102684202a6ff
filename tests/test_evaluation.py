"""Metrics, pooling, fusion, quantiles and checks on hand cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlab.operators import checks, evaluate, pool, quantiles
from searchlab.operators.fusion import reciprocal_rank_fusion
from searchlab.sources.readers import typed_run

RUN = "system string, query_id string, doc_id string, rank int, latency_ms double"
QRELS = "query_id string, doc_id string, relevance double, query string, category string"


def make_run(spark, docs, query="q", system="s", ranks=None, latency=1.5):
    ranks = ranks or range(1, len(docs) + 1)
    return spark.createDataFrame([(system, query, d, r, latency) for d, r in zip(docs, ranks)], RUN)


def make_qrels(spark, grades, query="q", category="c"):
    return spark.createDataFrame([(query, d, float(g), "text", category) for d, g in grades.items()], QRELS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_ndcg_hand_case(spark):
    qrels = make_qrels(spark, {"a": 3, "b": 2, "x": 3, "y": 1})
    row = one(evaluate.metrics_per_query(make_run(spark, ["a", "b", "unjudged"]), qrels))
    assert math.isclose(row["ndcg_at_10"], 0.666267, abs_tol=1e-6)
    assert math.isclose(one(evaluate.ideal_dcg(qrels))["ideal_dcg"], 13.347184, abs_tol=1e-6)
    assert row["judged_at_10"] == 2 and row["retrieved_at_10"] == 3
    assert row["precision_at_10"] == 0.2
    assert row["recall_at_10"] == 2 / 3
    assert row["judged_documents"] == 4 and row["relevant_judged_documents"] == 3


def test_reciprocal_rank_needs_the_threshold(spark):
    row = one(evaluate.metrics_per_query(make_run(spark, ["a", "b", "c"]), make_qrels(spark, {"a": 1, "b": 1, "c": 2})))
    assert row["mrr_at_10"] == 1 / 3


def test_precision_divides_by_k(spark):
    row = one(evaluate.metrics_per_query(make_run(spark, ["a", "b", "c"]), make_qrels(spark, {"a": 3, "b": 3, "c": 2})))
    assert row["precision_at_10"] == 0.3


def test_gaps_in_ranks_are_closed(spark):
    run = make_run(spark, ["a", "b", "c"], ranks=[2, 5, 9])
    row = one(evaluate.metrics_per_query(run, make_qrels(spark, {"c": 3})))
    assert row["mrr_at_10"] == 1 / 3


def test_judged_query_without_results(spark):
    qrels = make_qrels(spark, {"a": 3}, "q").unionAll(make_qrels(spark, {"a": 2}, "empty"))
    rows = {r["query_id"]: r for r in evaluate.metrics_per_query(make_run(spark, ["a"]), qrels).collect()}
    row = rows["empty"]
    assert [row[f"{m}_at_10"] for m in ("ndcg", "mrr", "precision", "recall", "retrieved")] == [0] * 5
    assert row["judgement_coverage_at_10"] == 0 and row["latency_ms"] is None
    assert rows["q"]["latency_ms"] == 1.5


def test_query_only_in_the_run_is_dropped(spark):
    run = make_run(spark, ["a"], "other").unionAll(make_run(spark, ["a"]))
    assert one(evaluate.metrics_per_query(run, make_qrels(spark, {"a": 1})))["query_id"] == "q"


def test_named_system_without_any_result(spark):
    rows = evaluate.metrics_per_query(make_run(spark, ["a"]), make_qrels(spark, {"a": 3}), systems=["s", "t"])
    assert {r["system"]: r["ndcg_at_10"] for r in rows.collect()} == {"s": 1.0, "t": 0.0}


def test_ideal_list_scores_one(spark):
    grades = {f"d{i}": g for i, g in enumerate([3, 3, 2, 2, 1, 1, 0])}
    row = one(evaluate.metrics_per_query(make_run(spark, list(grades)), make_qrels(spark, grades)))
    assert math.isclose(row["ndcg_at_10"], 1.0) and row["judgement_coverage_at_10"] == 1.0


def test_no_run_rows_at_all(spark):
    qrels = make_qrels(spark, {"a": 3})
    empty = make_run(spark, ["a"]).limit(0)
    assert evaluate.metrics_per_query(empty, qrels).count() == 0
    assert one(evaluate.metrics_per_query(empty, qrels, systems=["s"]))["ndcg_at_10"] == 0


def test_only_zero_grades(spark):
    row = one(evaluate.metrics_per_query(make_run(spark, ["a"]), make_qrels(spark, {"a": 0})))
    assert row["ndcg_at_10"] == 0 and row["recall_at_10"] == 0


def test_first_known_latency_in_rank_order(spark):
    run = spark.createDataFrame(
        [("s", "q", "a", 1, None), ("s", "q", "b", 2, 7.0), ("s", "q", "c", 3, 1.0)], RUN
    )
    assert one(evaluate.metrics_per_query(run, make_qrels(spark, {"a": 1})))["latency_ms"] == 7.0


def test_parameters_are_checked(spark):
    run, qrels = make_run(spark, ["a"]), make_qrels(spark, {"a": 1})
    with pytest.raises(ValueError):
        evaluate.metrics_per_query(run, qrels, k=0)
    with pytest.raises(ValueError):
        evaluate.metrics_per_query(run, qrels, threshold=3.5)


# Published per-query results of an exact vector run and their published roll-up
# (fixed values).
PUBLISHED = {
    "data": [
        (0.6148352923016787, 0.4, 515.2642819998619),
        (0.8276541850139321, 0.8, 19.359463999990112),
        (0.7671912189922424, 1.0, 18.91044099966166),
        (0.5732030805356374, 1.0, 20.23030299960737),
    ],
    "software": [
        (0.827879884347265, 1.0, 23.610786000062944),
        (0.7792059123819695, 0.9, 21.803325999826484),
        (0.5799041252609625, 1.0, 24.77846300007513),
        (0.6440587583691855, 1.0, 20.14399700010472),
    ],
    "medicine": [
        (0.9552009891550427, 1.0, 19.94844499995452),
        (0.7020235183818109, 0.9, 19.04322600012165),
        (0.8489673177896404, 1.0, 19.89065700036008),
    ],
    "finance": [
        (0.6518747835820288, 0.6, 19.895456000085687),
        (0.5161430508899977, 0.9, 18.819339999936343),
        (0.3800771462513061, 0.7, 19.19236699995963),
    ],
    "marketing": [
        (0.9566150453737075, 0.9, 18.945455999983096),
        (0.9264983288251022, 1.0, 18.85006400016209),
    ],
    "project_management": [
        (0.623400080939452, 0.7, 18.93155800007662),
        (0.7317403027165548, 1.0, 18.958983000175067),
    ],
    "sales": [
        (0.877666448931519, 1.0, 19.710813000074268),
        (0.7676346971971055, 1.0, 23.573443999794108),
    ],
    "education": [
        (0.7860998276264536, 0.7, 22.18749899975592),
        (0.911671805955201, 1.0, 21.100755999668763),
    ],
    "operations": [
        (0.880543218576842, 1.0, 19.95397500013496),
        (0.9580777588003657, 1.0, 18.64805500008515),
    ],
    "customer_service": [(0.8600766329607304, 1.0, 19.17704900006356)],
}


def test_published_summary_is_reproduced(spark):
    flat = [(c, *row) for c, rows in PUBLISHED.items() for row in rows]
    per_query = spark.createDataFrame(
        [("flat", f"Q{i}", c, n, p, ms) for i, (c, n, p, ms) in enumerate(flat)],
        "system string, query_id string, category string, ndcg_at_10 double, "
        "precision_at_10 double, latency_ms double",
    ).select(
        "*",
        F.lit(1.0).alias("judgement_coverage_at_10"),
        F.lit(1.0).alias("mrr_at_10"),
        F.lit(0.5).alias("recall_at_10"),
    )
    row = one(evaluate.summary_by_system(per_query))
    assert row["query_count"] == 25
    assert math.isclose(row["ndcg_at_10"], 0.7579297364462293, abs_tol=1e-12)
    assert math.isclose(row["precision_at_10"], 0.9, abs_tol=1e-12)
    assert math.isclose(row["mean_latency_ms"], 40.03712819998327, abs_tol=1e-9)
    assert math.isclose(row["p95_latency_ms"], 24.54492760007269, abs_tol=1e-9)
    stats = one(quantiles.latency_stats(per_query))
    assert math.isclose(stats["p95_latency_ms"], 24.54492760007269, abs_tol=1e-9)
    assert stats["min_latency_ms"] == 18.64805500008515
    by_category = {r["category"]: r for r in evaluate.summary_by_category(per_query).collect()}
    assert math.isclose(by_category["data"]["ndcg_at_10"], 0.6957209442108726, abs_tol=1e-12)
    assert math.isclose(by_category["finance"]["precision_at_10"], 0.7333333333333334, abs_tol=1e-12)


def test_no_category_gives_an_empty_table(spark):
    qrels = make_qrels(spark, {"a": 1}).drop("category", "query")
    per_query = evaluate.metrics_per_query(make_run(spark, ["a"]), qrels)
    assert evaluate.summary_by_category(per_query).count() == 0
    assert evaluate.summary_by_system(per_query).count() == 1


@pytest.mark.parametrize("small", [0, quantiles.SMALL])
@pytest.mark.parametrize("p", [0.0, 0.25, 0.95, 1.0])
def test_exact_quantile(spark, small, p):
    rng = np.random.default_rng(1)
    groups = {
        "many": rng.exponential(size=3000),
        "copies": np.concatenate([np.full(700, 4.25), rng.normal(size=1300)]),
        "two": np.array([1.0, 2.0]),
        "one": np.array([5.0]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("many", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r["q"] for r in quantiles.exact_quantile(table, "g", "v", p, "q", small).collect()}
    assert got.keys() == groups.keys()
    for group, values in groups.items():
        assert math.isclose(got[group], np.quantile(values, p), abs_tol=1e-12)


def test_bits_of_doubles_keep_their_order(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([
        rng.normal(size=200), rng.integers(-(2**62), 2**62, 200).view(np.float64), 2.0 ** np.arange(-1074, 1024, 7),
        np.nextafter(2.0 ** np.arange(-1000, 1000, 31), 0), [0.0, 5e-324, 2.2250738585072014e-308, 1e308, np.inf, -np.inf],
    ])
    values = values[~np.isnan(values)]
    df = spark.createDataFrame([(float(x),) for x in values], "v double")
    got = {r.v: r.bits for r in df.select("v", quantiles.ordered_bits(F.col("v")).alias("bits")).collect()}
    want = {float(x): int(abs(x).view(np.int64)) * (-1 if x < 0 else 1) for x in values}
    assert got == want


def test_quantile_of_a_million_equal_values_and_of_any_order(spark):
    """The median lies between one value that all but two rows have, and rows that fall along the partitions."""
    n = 1_000_000
    equal = spark.range(n).select(F.lit("equal").alias("g"), F.when(F.col("id") < 2, -1.0).otherwise(7.5).alias("v"))
    falling = spark.range(200_001).select(F.lit("falling").alias("g"), (100_000.0 - F.col("id")).alias("v"))
    both = equal.unionAll(falling)
    for p, want in ((0.5, {"equal": 7.5, "falling": 0.0}), (0.9, {"equal": 7.5, "falling": 80_000.0})):
        found = quantiles.exact_quantile(both, "g", "v", p, "q")
        assert {r.g: r.q for r in found.collect()} == want
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


# --- pooling and fusion -----------------------------------------------------
def test_pool(spark):
    a = make_run(spark, ["d1", "d2", "d3"]).drop("system").withColumn("category", F.lit("c"))
    b = make_run(spark, ["d3", "d4"]).drop("system").withColumn("category", F.lit("c"))
    runs = pool.union_runs({"dense_flat": a, "bm25": b})
    rows = pool.pool_candidates(runs, source_top_k=3, max_candidates=3).collect()
    got = {r["doc_id"]: (r["source_systems"], r["system_count"], r["best_rank"]) for r in rows}
    assert got == {
        "d3": ("bm25, dense_flat", 2, 1),
        "d1": ("dense_flat", 1, 1),
        "d2": ("dense_flat", 1, 2),
    }
    corpus = spark.createDataFrame([("d1", "T", None)], "doc_id string, title string, company string")
    pooled = {r["doc_id"]: r for r in pool.annotation_pool(
        pool.pool_candidates(runs), corpus, ["title", "company"]).collect()}
    assert pooled["d1"]["company"] == "" and pooled["d1"]["relevance"] == ""
    assert pooled["d3"]["title"] is None
    assert tuple(one(pool.pool_stats(pool.pool_candidates(runs)))) == (4, 4.0, 4)


def test_reciprocal_rank_fusion(spark):
    runs = pool.union_runs({"a": make_run(spark, ["x", "y"]), "b": make_run(spark, ["y", "z"])})
    got = [(r["doc_id"], r["rrf"]) for r in sorted(reciprocal_rank_fusion(runs).collect(), key=lambda r: r["rank"])]
    want = [("y", 1 / 62 + 1 / 61), ("x", 1 / 61), ("z", 1 / 62)]
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)


# --- checks -----------------------------------------------------------------
def report(df):
    return {r["rule"]: r["n"] for r in df.collect()}


def raw_qrels(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, doc_id string, relevance string")


def test_qrels_report_and_cleaning(spark):
    raw = raw_qrels(
        spark, ("q", "a", "3"), ("q", "a", "3.0"), ("q", "b", " "), ("q", "c", None),
        ("q", "d", "x"), ("q", "e", "5"), ("q", "f", "1"), ("q", "f", "2"),
    )
    assert report(checks.qrels_report(raw)) == {
        "unlabelled": 2, "not_numeric": 1, "invalid_grade": 1, "conflicting_pairs": 1, "empty": 0,
    }
    with pytest.raises(ValueError, match="conflicting_pairs"):
        checks.raise_violations(checks.qrels_report(raw), "judgements")
    kept = {r["doc_id"]: r["relevance"] for r in checks.clean_qrels(raw, allow_incomplete=True).collect()}
    assert kept == {"a": 3.0, "b": 0.0, "c": 0.0, "f": 1.0}
    strict = checks.clean_qrels(raw_qrels(spark, ("q", "a", "3"), ("q", "b", "")))
    assert [r["doc_id"] for r in strict.collect()] == ["a"]
    assert report(checks.qrels_report(raw.limit(0)))["empty"] == 1


def test_run_report(spark):
    raw = spark.createDataFrame(
        [("q", "a", "1"), ("q", "b", "1"), ("q", "a", "3"), ("q", "c", "0"), ("q", "d", "x")],
        "query_id string, doc_id string, rank string",
    )
    assert report(checks.run_report(raw)) == {
        "invalid_rank": 2, "duplicate_document": 1, "duplicate_rank": 1,
    }
    assert {r["system"] for r in typed_run(raw, "mine").collect()} == {"mine"}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="doc_id"):
        checks.require_columns(spark.range(1), ["id", "doc_id"], "table")


def test_vector_report(spark):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [1.0]), ("c", None), ("d", [float("nan"), 0.0])],
        "doc_id string, embedding array<double>",
    )
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string")
    assert report(checks.vector_report(vectors, keys, 2)) == {
        "null_vector": 1, "wrong_dimension": 1, "not_a_number": 1, "wrong_element_type": 4, "repeated_id": 0,
        "vector_without_document": 2, "document_without_vector": 1,
    }
    twice = vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).unionAll(
        spark.createDataFrame([("a", [0.0, 0.0]), ("a", [0.0, 0.0])], vectors.schema)
    )
    twice = twice.withColumn("embedding", F.col("embedding").cast("array<float>"))
    found = report(checks.vector_report(twice, keys, 2))
    assert found["repeated_id"] == 1 and found["wrong_element_type"] == 0


def test_content_fingerprint(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None), (3, "", [])], "k int, t string, v array<double>")
    columns = ["k", "t", "v"]
    same = checks.content_fingerprint(df, columns)
    assert same.startswith("3:") and same == checks.content_fingerprint(df.orderBy(F.desc("k")).repartition(3), columns)
    for changed in (df.fillna(""), df.unionAll(df.limit(1)), df.withColumn("k", F.col("k") + 1), df.withColumn("t", F.lit("a"))):
        assert checks.content_fingerprint(changed, columns) != same
    assert checks.content_fingerprint(df.filter("k < 0"), columns) == "0:0"


def test_stale_report_names_what_differs(spark, tmp_path):
    where = str(tmp_path / "index")
    checks.write_manifest(spark, where, documents=5, weights={"title": 3.0})
    got = checks.stale_artefact_report(spark, where, documents=6, weights={"title": 3.0}).collect()
    assert [tuple(r) for r in got] == [("documents", "5", "6")]
    assert checks.stale_artefact_report(spark, where, documents=5).count() == 0
    assert [r.stored for r in checks.stale_artefact_report(spark, str(tmp_path / "none"), documents=5).collect()] == [None]


def test_stale_report_reads_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """Documents of one language only: they still are spread over many tasks."""
    from searchlab.plans import catalog_search

    documents = spark.range(0, 4000, 1, 8).select(
        F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("text"), F.lit("en").alias("lang")
    )
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    largest = []

    def spied(df, columns, fingerprint=checks.content_fingerprint):
        parts = df.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("size"))
        largest.append(parts.agg(F.max("size") / F.sum("size")).first()[0])
        return fingerprint(df, columns)

    monkeypatch.setattr(checks, "content_fingerprint", spied)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        facts = {r.fact for r in catalog_search.stale_artefact_report(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert facts == {"content", "weights"} and largest[1] <= 0.25


def test_manifest_refuses_stale_artefacts(spark, tmp_path):
    where = str(tmp_path / "vectors")
    assert not checks.reusable(spark, where, documents=5)
    checks.write_manifest(spark, where, documents=5, dimension=64)
    assert checks.reusable(spark, where, documents=5, dimension=64)
    assert not checks.reusable(spark, where, rebuild=True, documents=6)
    with pytest.raises(ValueError, match="stale"):
        checks.reusable(spark, where, documents=6)
