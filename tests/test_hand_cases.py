"""Cases that once gave wrong results."""

from searchlab.operators import ann, profile
from searchlab.plans.corpus_build import clean_postings, matching_text
from searchlab.sources.readers import typed_run


def test_a_row_without_title_does_not_win(spark):
    jobs = spark.createDataFrame(
        [("l1", None, "b"), ("l1", "Engineer", "a"), ("l2", "Cook", None)],
        "job_link string, job_title string, company string",
    )
    cleaned = clean_postings(jobs, metadata=["company"]).collect()
    assert sorted((r.job_link, r.job_title) for r in cleaned) == [("l1", "Engineer"), ("l2", "Cook")]


def test_a_null_text_does_not_win(spark):
    texts = spark.createDataFrame([("l1", None), ("l1", "real")], "job_link string, summary string")
    assert [r.summary for r in matching_text(texts, "summary", texts).collect()] == ["real"]


def test_fractional_ranks_are_not_cut(spark):
    run = spark.createDataFrame([("q", "d1", "1.2"), ("q", "d2", "1.0"), ("q", "d3", "x")], "query_id string, doc_id string, rank string")
    assert {r.doc_id: r.rank for r in typed_run(run, "s").collect()} == {"d1": None, "d2": 1, "d3": None}


def test_lengths_of_one_document(spark):
    row = profile.length_describe(spark.createDataFrame([("two words",)], "text string"), "text").first()
    assert row["count"] == 1 and row["mean"] == 2 and row["std"] is None


def test_pivots_of_text_ids(spark):
    vectors = spark.createDataFrame(
        [(f"JOB_{i:07}", [float(i), 1.0]) for i in range(20)], "doc_id string, embedding array<double>"
    )
    centroids = ann.pivot_centroids(vectors, 4)
    assert sorted(r.cell for r in centroids.collect()) == [1, 2, 3, 4]
    assert ann.assign_cells(vectors, centroids).count() == 20
