"""Raw files -> corpus, profile, and the sinks."""

import json

import pytest
from pyspark.sql import functions as F

from searchlab.operators import profile
from searchlab.operators.dedup import keep_first
from searchlab.operators.encode import HashedEncoder, encode_texts
from searchlab.plans.corpus_build import build_corpus, clean_postings
from searchlab.sources import readers, writers

HEADER = ",".join(readers.POSTING_COLUMNS) + ",extra"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    jobs = [HEADER]
    for i in range(60):
        company = f"Company {i % 7}"
        jobs.append(f'L{i},"Title, &amp; {i}",{company},Here,City,NA,Pos,Mid,Onsite,x')
    jobs.append(jobs[1])  # copy of a whole row
    jobs.append("L1,zz other title,Company,Here,City,US,Pos,Mid,Onsite,y")  # same link
    jobs.append(',"No link",C,Here,City,US,Pos,Mid,Onsite,z')
    jobs.append("LX,<b></b>,C,Here,City,US,Pos,Mid,Onsite,z")  # title empty when cleaned
    (folder / "jobs.csv").write_text("\n".join(jobs) + "\n")
    summaries = ["job_link,job_summary"]
    summaries += [f'L{i},"Line one\n""quoted"" {i // 2}"' for i in range(50)]
    summaries.append("L0,zzz second text of one link")
    (folder / "summaries.csv").write_text("\n".join(summaries) + "\n")
    skills = ["job_link,job_skills"] + [f"L{i},\"sql, spark\"" for i in range(40, 55)]
    (folder / "skills.csv").write_text("\n".join(skills) + "\n")
    return folder


def load(spark, raw):
    return (
        readers.read_postings(spark, str(raw / "jobs.csv")),
        readers.read_text_table(spark, str(raw / "summaries.csv"), "job_summary"),
        readers.read_text_table(spark, str(raw / "skills.csv"), "job_skills"),
    )


def test_missing_tokens_become_null(spark, raw):
    jobs, *_ = load(spark, raw)
    assert jobs.columns == readers.POSTING_COLUMNS
    assert jobs.filter(F.col("search_country").isNull()).count() == 61


def test_clean_postings(spark, raw):
    cleaned = {r["job_link"]: r for r in clean_postings(load(spark, raw)[0]).collect()}
    assert len(cleaned) == 60
    assert cleaned["L1"]["job_title"] == "Title, & 1"
    assert cleaned["L1"]["search_country"] == ""


def test_build_corpus(spark, raw):
    corpus = build_corpus(*load(spark, raw), sample_size=1000, check_keys=True)
    rows = sorted(corpus.collect(), key=lambda r: r["doc_id"])
    # L55..L59 have no text; titles differ, so no two contents are equal.
    assert {r["job_link"] for r in rows} == {f"L{i}" for i in range(55)}
    assert [r["doc_id"] for r in rows] == [f"JOB_{i:07d}" for i in range(1, 56)]
    by_link = {r["job_link"]: r for r in rows}
    assert by_link["L45"]["search_text"] == (
        'Title: Title, & 45. Summary: Line one "quoted" 22. Skills: sql, spark.'
    )
    assert by_link["L52"]["search_text"] == "Title: Title, & 52. Skills: sql, spark."


def test_final_size(spark, raw):
    assert build_corpus(*load(spark, raw), sample_size=1000, final_size=20).count() == 20
    with pytest.raises(ValueError):
        build_corpus(*load(spark, raw), sample_size=30, final_size=50)


def test_keep_first_with_a_hot_key(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        (1000 - F.col("id")).alias("order"),
    )
    kept = keep_first(rows.repartition(6), ["key"], ["order"])
    assert kept.count() == 335
    assert kept.filter("key = 'hot'").first()["order"] == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # one of them before the shuffle


def test_sinks_can_be_read_back(spark, raw, tmp_path):
    corpus = build_corpus(*load(spark, raw), sample_size=1000)
    writers.write_corpus(corpus, str(tmp_path / "corpus"))
    again = readers.read_corpus(spark, str(tmp_path / "corpus"), ["doc_id", "job_title"], first=3)
    assert [r["doc_id"] for r in again.collect()] == [f"JOB_{i:07d}" for i in range(1, 4)]

    run = spark.createDataFrame(
        [("s", "q", "d1", 1, 0.5, 2.0), ("s", "q", "d2", 2, 0.25, 2.0)],
        "system string, query_id string, doc_id string, rank int, score double, latency_ms double",
    )
    writers.write_run(run, str(tmp_path / "run_csv"), as_csv=True)
    loaded = readers.read_run(spark, str(tmp_path / "run_csv"), "renamed")
    assert [(r["system"], r["rank"], r["score"]) for r in loaded.orderBy("rank").collect()] == [
        ("renamed", 1, 0.5), ("renamed", 2, 0.25),
    ]
    writers.write_run(run, str(tmp_path / "run"))
    assert (tmp_path / "run" / "system=s").is_dir()

    from searchlab.operators.quantiles import latency_stats

    writers.write_metrics_json(writers.run_metrics(run, latency_stats(run), 20), str(tmp_path / "json"))
    part = next((tmp_path / "json").glob("*.json")).read_text()
    assert json.loads(part)["mean_latency_ms"] == 2.0


def test_evaluation_sinks(spark, tmp_path):
    from searchlab.operators import evaluate

    run = spark.createDataFrame([("s", "q", "d1", 1)], "system string, query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d1", 3.0)], "query_id string, doc_id string, relevance double")
    per_query = evaluate.metrics_per_query(run, qrels)
    writers.write_evaluation(
        per_query, evaluate.summary_by_system(per_query), evaluate.summary_by_category(per_query),
        str(tmp_path / "eval"),
    )
    assert (tmp_path / "eval" / "summary_metrics").is_dir()
    assert not (tmp_path / "eval" / "category_metrics").exists()


def test_profile_edge_cases(spark):
    same = spark.createDataFrame([("a b",), ("c d",)], "text string")
    rows = [tuple(r) for r in profile.length_histogram(same, "text").collect()]
    assert rows == [(21, 2)]
    shares = profile.value_shares(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string"), "x")
    assert {r["value"]: round(r["share"], 4) for r in shares.collect()} == {"a": 66.6667, "b": 33.3333}


def test_encoder_calls_nothing_for_known_words():
    class Counted(HashedEncoder):
        calls = 0

        def _slot(self, word):
            self.calls += 1
            return super()._slot(word)

    encoder = Counted()
    text = "the cat and the dog and the end"
    first, asked = encoder.encode([text, ""]), encoder.calls
    assert asked == 5 and (encoder.encode([text, ""]) == first).all() and encoder.calls == asked
    # Each word at its place: 1 + ln(tf), signed, unit length.
    import hashlib
    import math

    want = [0.0] * encoder.dimension
    for word, tf in {"the": 3, "cat": 1, "and": 2, "dog": 1, "end": 1}.items():
        digest = hashlib.md5(word.encode()).hexdigest()
        want[int(digest[:8], 16) % encoder.dimension] += (1 + math.log(tf)) * (1 if digest[-1] < "8" else -1)
    assert first[0] == pytest.approx([x / math.hypot(*want) for x in want]) and not first[1].any()


def test_encoder_is_pluggable(spark):
    texts = spark.createDataFrame([(i, f"word{i} word") for i in range(70)] + [(70, "")], "doc_id bigint, text string")
    plain = HashedEncoder().encode(["passage: word3 word"])[0]
    rows = {r["doc_id"]: r["embedding"] for r in encode_texts(texts, ["doc_id"], F.col("text"), "passage: ").collect()}
    assert len(rows) == 71 and rows[3] == pytest.approx(plain.tolist())

    class Length:
        dimension = 1

        def encode(self, batch):
            import numpy as np

            assert len(batch) <= 32
            return np.array([[float(len(t))] for t in batch])

    rows = encode_texts(texts, ["doc_id"], F.col("text"), encoder=Length).collect()
    assert {r["doc_id"]: r["embedding"] for r in rows}[70] == [0.0]
