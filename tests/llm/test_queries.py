from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from searchlab.llm import edit_match, quality, queries
from searchlab.llm.common import table
from tests.compare import difference
from tests.llm.test_dedup import brute_force

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECK_SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table_name in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table_name} AS SELECT * FROM '{SF}/{table_name}.parquet'")
    cursor = connection.execute(queries.CHECK_SQL[name])
    names = [d[0] for d in cursor.description]
    result = queries.QUERIES[name](spark, SF)
    assert difference(result.columns, [tuple(r) for r in result.collect()], names, cursor.fetchall()) is None


def test_pipeline_equals_its_steps(spark):
    docs = table(spark, SF, "documents")
    accepted = {r.doc_id for r in quality.quality_scores(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in accepted}
    by_text = defaultdict(list)
    for doc, text in texts.items():
        by_text[text].append(doc)
    unique = [(max(ids), text) for text, ids in by_text.items()]
    near = brute_force(unique, 5)
    left = {doc: text for doc, text in unique if near[doc][2]}
    matcher = edit_match.Matcher(edit_match.plain_items(table(spark, SF, "benchmark"), "item_id", "text"), edit_match.RATE)
    clean = {doc for doc, text in left.items() if not list(matcher.matches(edit_match.plain(text)))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == clean
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage_rejects_documents(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rejected = [truth[r.doc_id] for r in docs.collect() if r.doc_id in truth and r.doc_id not in kept]
    assert rejected.count(0) >= 8 and rejected.count(1) <= 3
    assert 0 < len(kept) < docs.count()


def test_stages_on_empty_documents(spark):
    docs = table(spark, SF, "documents").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
