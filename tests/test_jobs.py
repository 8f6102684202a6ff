"""All steps from raw files to metrics, through files only."""

import pytest
from pyspark.sql import functions as F

from searchlab.plans import jobs
from searchlab.sources.readers import POSTING_COLUMNS

TOPICS = {
    "nurse": "hospital care patient ward nurse",
    "spark": "data engineer spark sql cloud",
    "teacher": "school teacher lesson class pupils",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    topics = list(TOPICS)
    jobs_csv = [",".join(POSTING_COLUMNS)]
    summaries, skills = ["job_link,job_summary"], ["job_link,job_skills"]
    for i in range(90):
        topic = topics[i % 3]
        jobs_csv.append(f"L{i},{topic} job {i},C{i % 5},Here,City,US,{topic},Mid,Onsite")
        words = TOPICS[topic].split()
        summaries.append(f'L{i},"{" ".join(words[: 2 + i % 4])} number {i}"')
        skills.append(f'L{i},"{words[i % 5]}, {words[(i + 1) % 5]}"')
    (folder / "jobs.csv").write_text("\n".join(jobs_csv))
    (folder / "summaries.csv").write_text("\n".join(summaries))
    (folder / "skills.csv").write_text("\n".join(skills))
    queries = ["query_id,query,category"]
    queries += [f"Q{i},{text},{name}" for i, (name, text) in enumerate(TOPICS.items())]
    (folder / "queries.csv").write_text("\n".join(queries))
    return folder


def test_whole_experiment(spark, folder):
    at = lambda name: str(folder / name)
    corpus = jobs.build_corpus_file(
        spark, at("jobs.csv"), at("summaries.csv"), at("skills.csv"), at("corpus"), 80
    )
    assert corpus.count() == 80

    runs = {"bm25": at("bm25"), "dense_flat": at("dense")}
    jobs.lexical_run(spark, at("corpus"), at("queries.csv"), at("index"), runs["bm25"])
    again = jobs.lexical_run(spark, at("corpus"), at("queries.csv"), at("index"), runs["bm25"])
    assert again.groupBy("query_id").count().filter("count <> 20").count() == 0
    assert again.filter("rank = 1").join(corpus, "doc_id").filter(
        F.col("category") != F.col("search_position")
    ).count() == 0

    jobs.encode_corpus(spark, at("corpus"), at("vectors"))
    jobs.dense_run(
        spark, at("corpus"), at("queries.csv"), at("vectors"), runs["dense_flat"], metrics=at("dense_record")
    )
    record = spark.read.json(at("dense_record")).first()
    assert (record["documents"], record["query_count"], record["top_k"]) == (80, 3, 20)
    assert record["dimension"] == len(spark.read.parquet(at("vectors")).first()["embedding"])

    recall = jobs.cell_runs(
        spark, at("corpus"), at("queries.csv"), at("vectors"), at("cells"), at("cell_runs"),
        at("cell_metrics"), probes=[1, 5], cell_count=5,
    )
    values = {r["nprobe"]: r["ann_recall_at_10"] for r in recall.collect()}
    assert values[5] == 1.0 and 0 < values[1] <= 1
    runs["ivf_c5_p1"] = at("cell_runs/system=ivf_c5_p1")

    report = jobs.reduce_vectors(
        spark, at("vectors"), at("reduced"), at("model"), at("reduction"), [4, 8]
    )
    assert [r["compression_ratio"] for r in report.orderBy("output_dimension").collect()] == [32, 16]
    jobs.reduced_dense_run(
        spark, at("corpus"), at("queries.csv"), at("reduced"), at("model"), at("pca8"), 8
    )
    with pytest.raises(ValueError):
        jobs.reduced_dense_run(
            spark, at("corpus"), at("queries.csv"), at("reduced"), at("model"), at("pca5"), 5
        )
    runs["dense_pca8"] = at("pca8")

    pooled = jobs.annotation_pool_file(spark, runs, at("corpus"), at("pool"))
    assert pooled.groupBy("query_id").count().filter("count > 20").count() == 0
    with pytest.raises(ValueError, match="unlabelled"):
        jobs.evaluate_files(spark, at("pool"), runs, at("metrics"))

    # Grade every pooled document by the topic of its posting.
    graded = pooled.join(corpus.select("doc_id", "search_position"), "doc_id").withColumn(
        "relevance", F.when(F.col("search_position") == F.col("category"), 3).otherwise(0)
    )
    graded.drop("search_position").coalesce(1).write.csv(at("qrels"), header=True)
    summary, per_query, by_category = jobs.evaluate_files(spark, at("qrels"), runs, at("metrics"))
    rows = {r["system"]: r for r in summary.collect()}
    assert rows.keys() == runs.keys()
    assert rows["bm25"]["ndcg_at_10"] == pytest.approx(1.0)
    assert per_query.count() == 12 and by_category.count() == 12
    assert (folder / "metrics" / "category_metrics").is_dir()


def test_artefacts_of_another_corpus_are_refused(spark, folder):
    at = lambda name: str(folder / name)
    spark.read.parquet(at("corpus")).limit(10).write.parquet(at("small_corpus"))
    with pytest.raises(ValueError, match="stale"):
        jobs.encode_corpus(spark, at("small_corpus"), at("vectors"))
    with pytest.raises(ValueError, match="stale"):
        jobs.lexical_run(spark, at("small_corpus"), at("queries.csv"), at("index"), at("x"))


def test_profile(spark, folder):
    tables = jobs.profile_corpus(spark, str(folder / "corpus"))
    assert tables["lengths"].first()["count"] == 80
    assert sum(r["n"] for r in tables["length_histogram"].collect()) == 80
    assert {r["column"]: r["n"] for r in tables["distinct"].collect()}["company"] == 5
    assert tables["countries"].first()["value"] == "US"


def test_search_metrics(spark, tmp_path):
    run = spark.createDataFrame(
        [("s", "q1", 2.0), ("s", "q2", 4.0)], "system string, query_id string, latency_ms double"
    )
    record = jobs.search_metrics(run, str(tmp_path / "json")).first()
    assert (record["query_count"], record["mean_latency_ms"], record["max_latency_ms"]) == (2, 3, 4)
