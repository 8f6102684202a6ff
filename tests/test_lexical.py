"""BM25 against SQLite's full-text index, and the index files."""

import random
import sqlite3

import pytest

from searchlab.operators import lexical

WORDS = "spark data café naïve sql c java python with and the of engineer nurse x2 déjà".split()


def random_corpus(seed, size=120):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    corpus = [(i, text(4), text(5), text(30)) for i in range(size)]
    # A third of the corpus are copies of one document.
    return [(i, *corpus[0][1:]) if i % 3 == 0 else row for i, row in enumerate(corpus)]


def fts_scores(corpus, query):
    db = sqlite3.connect(":memory:")
    db.execute(
        "CREATE VIRTUAL TABLE d USING fts5(id UNINDEXED, title, skills, summary,"
        " tokenize = 'unicode61')"
    )
    db.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", corpus)
    match = " OR ".join(f'"{w}"' for w in query)
    return dict(
        db.execute("SELECT id, -bm25(d, 0, 3, 2, 1) FROM d WHERE d MATCH ?", (match,)).fetchall()
    )


@pytest.mark.parametrize("prune_from", [0, lexical.PRUNE_FROM])
@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_fts5(spark, seed, prune_from):
    corpus = random_corpus(seed)
    docs = spark.createDataFrame(
        corpus, "doc_id bigint, title string, skills string, summary string"
    )
    index = lexical.write_index(docs, buckets=4)
    rng = random.Random(seed)
    asked = [(f"q{i}", rng.choices(["spark", "sql", "nurse", "with", "cafe", "x2"], k=4)) for i in range(6)]
    queries = spark.createDataFrame([(q, " ".join(w)) for q, w in asked], "query_id string, query string")
    found = lexical.search_bm25(index, queries, k=len(corpus), prune_from=prune_from).collect()
    for query_id, words in asked:
        want = fts_scores(corpus, words)
        got = {r["doc_id"]: r["score"] for r in found if r["query_id"] == query_id}
        assert got.keys() == want.keys()
        assert all(abs(got[d] - want[d]) < 1e-6 for d in want)
    counts = {r["query_id"]: r["n_docs"] for r in lexical.match_counts(index, queries).collect()}
    assert counts == {q: len(fts_scores(corpus, w)) for q, w in asked}


def test_common_words_are_ranked_by_their_whole_score(spark):
    """A word of every document has the least weight; the order still is that of the scores."""
    corpus = [(i, "the", " ".join(["pad"] * (i * 7 % 13)), "the " * (1 + i * 5 % 11)) for i in range(40)]
    docs = spark.createDataFrame(corpus, "doc_id bigint, title string, skills string, summary string")
    queries = spark.createDataFrame([("q", "the")], "query_id string, query string")
    rows = lexical.search_bm25(lexical.write_index(docs), queries, k=40).collect()
    want = fts_scores(corpus, ["the"])
    got = {r["doc_id"]: r["score"] for r in rows}
    assert got.keys() == want.keys() and max(want.values()) < 1e-5
    assert all(abs(got[d] - want[d]) <= 1e-9 * want[d] for d in want)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"])]
    assert order == sorted(want, key=lambda d: (-float(f"{want[d]:.11e}"), d))
    assert order != sorted(order)


def test_top_k_breaks_ties_by_document(spark):
    docs = spark.createDataFrame(
        [(i, "same", "", "") for i in range(50)] + [(99, "other", "", "")],
        "doc_id bigint, title string, skills string, summary string",
    )
    queries = spark.createDataFrame([("q", "same")], "query_id string, query string")
    rows = lexical.search_bm25(lexical.write_index(docs), queries, k=5).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in rows) == [(i + 1, i) for i in range(5)]


def test_documents_without_tokens_count(spark):
    schema = "doc_id bigint, title string, skills string, summary string"
    docs = spark.createDataFrame([(1, "a b", "", ""), (2, "", "--", ""), (3, None, None, None)], schema)
    index = lexical.write_index(docs)
    assert tuple(index.totals.select("documents", "tokens").first()) == (3, 2)
    queries = spark.createDataFrame([("q", "a a"), ("none", "zzz")], "query_id string, query string")
    row = lexical.search_bm25(index, queries).collect()
    assert [(r["query_id"], r["doc_id"]) for r in row] == [("q", 1)]
    once = spark.createDataFrame([("q", "a")], "query_id string, query string")
    assert abs(row[0]["score"] - 2 * lexical.search_bm25(index, once).first()["score"]) < 2e-6


def test_saved_index_is_pruned_by_bucket(spark, tmp_path):
    docs = spark.createDataFrame(
        random_corpus(3), "doc_id bigint, title string, skills string, summary string"
    )
    lexical.write_index(docs, str(tmp_path / "index"), buckets=8)
    index = lexical.read_index(spark, str(tmp_path / "index"))
    assert index.buckets == 8
    queries = spark.createDataFrame([("q", "nurse")], "query_id string, query string")
    for prune_from in (0, lexical.PRUNE_FROM):
        found = lexical.search_bm25(index, queries, prune_from=prune_from)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan
        assert "SortMergeJoin" not in plan


def test_query_without_token_is_refused(spark):
    queries = spark.createDataFrame([("q1", "ok"), ("q2", "+++")], "query_id string, query string")
    with pytest.raises(ValueError, match="q2"):
        lexical.require_searchable(queries)


def zipf_corpus(seed, size):
    """Documents of many lengths: a few words of everywhere, many of nearly nowhere."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    rows = []
    for i in range(size):
        n = int(20 * 2 ** (rng.random() * 4))
        found = rng.choices(words, weights, k=n)
        rows.append((i, " ".join(found[:3]), " ".join(found[3:6]), " ".join(found[6:])))
    return rows


@pytest.mark.parametrize("k", [1, 20])
def test_pruned_search_equals_the_whole_one_and_skips_common_words(spark, k):
    corpus = zipf_corpus(k, 1000)
    docs = spark.createDataFrame(corpus, "doc_id bigint, title string, skills string, summary string")
    index = lexical.write_index(docs)
    rng = random.Random(7)
    asked = [(f"q{i}", " ".join(rng.sample(rng.choice(corpus)[3].split(), 8) + ["w0", "w1", "w2"])) for i in range(12)]
    asked += [("common", "w0 w1 w2 w3"), ("one", "w1999"), ("rare", "w1500 w1501 w0")]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    whole = key(lexical.search_bm25(index, queries, k))
    assert key(lexical.search_bm25(index, queries, k, prune_from=0)) == whole
    counts = {r.query_id: r for r in lexical.prune(index, lexical.weighted_terms(index, queries), k).counts().collect()}
    long = [counts[f"q{i}"] for i in range(12)]
    assert sum(r.postings_read for r in long) < 0.5 * sum(r.postings for r in long)
    matched = {r.query_id: r.n_docs for r in lexical.match_counts(index, queries).collect()}
    assert sum(r.documents_kept for r in long) < 0.25 * sum(matched[r.query_id] for r in long)


def test_sums_that_cannot_matter_are_no_rows(spark):
    """A part of the documents passes on what reaches its own k-th best; the result is that of the whole search."""
    corpus = zipf_corpus(3, 1500)
    docs = spark.createDataFrame(corpus, "doc_id bigint, title string, skills string, summary string")
    index = lexical.write_index(docs)
    rng = random.Random(5)
    asked = [(f"q{i}", " ".join(rng.sample(rng.choice(corpus)[3].split(), 8) + ["w0", "w1"])) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    found = lexical.prune(index, lexical.weighted_terms(index, queries), 1)
    summed = sum(r.documents_summed for r in found.counts().collect())
    assert found.sums.count() < 0.5 * summed
    matched = {}
    for row in index.postings.join(found.blocks.filter("not aside"), ["bucket", "term", "class"]).collect():
        matched.setdefault(row.query_id, set()).add(row.doc_id)
    assert summed == sum(map(len, matched.values()))


def test_bounds_of_a_task_do_not_change_results(spark, monkeypatch):
    """Blocks of queries, parts of documents and products at once: many small ones give what one gives, ties too."""
    corpus = random_corpus(4) + [(None, "spark sql", "", "nurse"), (7, "spark", "sql", "java")]
    docs = spark.createDataFrame(corpus, "doc_id bigint, title string, skills string, summary string")
    index = lexical.write_index(docs, buckets=4)
    asked = [(f"q{i}", " ".join(random.Random(i).choices(["spark", "sql", "nurse", "with", "cafe", "x2"], k=4))) for i in range(8)]
    queries = spark.createDataFrame([*asked, (None, "java sql")], "query_id string, query string")
    key = lambda df: sorted((str(r.query_id), r["rank"], str(r.doc_id), round(r.score, 9)) for r in df.collect())
    whole = {k: key(lexical.search_bm25(index, queries, k)) for k in (3, 200)}
    for name, size in (("QUERIES_AT_ONCE", 3), ("PART_POSTINGS", 40), ("PRODUCTS_AT_ONCE", 30)):
        monkeypatch.setattr(lexical, name, size)
    for k, want in whole.items():
        assert key(lexical.search_bm25(index, queries, k)) == want
    assert {row[0] for row in whole[3]} == {*(q for q, _ in asked), "None"}
    rows = [r for r in whole[200] if r[0] == "None"]
    assert {r[2] for r in rows} >= {"None", "7"} and len({r[2] for r in rows}) == len(rows)


def test_counting_inside_of_the_row(spark):
    docs = spark.createDataFrame(
        [(1, "b a A", "a", "zz b a"), (2, None, "", "x"), (3, "", "", None)],
        "doc_id bigint, title string, skills string, summary string",
    )
    postings = lexical.build_postings(docs)
    assert sorted(tuple(r) for r in postings.collect()) == [
        (1, 7, "a", 9.0, 4), (1, 7, "b", 4.0, 2), (1, 7, "zz", 1.0, 1), (2, 1, "x", 1.0, 1),
    ]
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    only = lexical.build_postings(docs, fields={"summary": 2.5})
    assert sorted(tuple(r) for r in only.collect()) == [
        (1, 3, "a", 2.5, 1), (1, 3, "b", 2.5, 1), (1, 3, "zz", 2.5, 1), (2, 1, "x", 2.5, 1),
    ]


def test_postings_travel_as_blocks(spark):
    """Terms of many documents make far fewer rows for the shuffle and the sort than postings."""
    docs = spark.createDataFrame(
        [(i, "a b", "c", f"d e{i % 3}") for i in range(600)], "doc_id bigint, title string, skills string, summary string"
    ).coalesce(1)
    blocks = lexical._posting_blocks(docs, "doc_id", lexical.FIELD_WEIGHTS)
    assert lexical.build_postings(docs).count() == 3000 and blocks.count() <= 20
    assert {r.term for r in blocks.collect()} == {"a", "b", "c", "d", "e0", "e1", "e2"}


def test_match_counts_of_more_queries_than_a_mask_holds(spark, monkeypatch):
    """A posting meets the queries that share its term as bits of few masks, not one by one."""
    docs = spark.createDataFrame(zipf_corpus(1, 60), "doc_id bigint, title string, skills string, summary string")
    index = lexical.write_index(docs)
    held = {}
    for row in index.postings.collect():
        held.setdefault(row.term, set()).add(row.doc_id)
    words = sorted(held, key=lambda w: (-len(held[w]), w))
    texts = {f"q{i}": f"{words[0]} {words[i % len(words)]} absentword" for i in range(150)}
    rows = [*texts.items(), ("q0", words[-1]), (None, words[-1]), ("nothing", "absentword")]
    asked, met = spark.createDataFrame(rows, "query_id string, query string"), []
    matches = lexical._matches

    def spied(*given):
        found = matches(*given)
        met.append(found.count())
        return found

    monkeypatch.setattr(lexical, "_matches", spied)
    want = {}
    for query_id, text in rows:
        docs_of = set().union(*[held.get(w, set()) for w in text.split()])
        want[query_id] = want.get(query_id, set()) | docs_of
    got = {r.query_id: r.n_docs for r in lexical.match_counts(index, asked).collect()}
    assert got == {q: len(d) for q, d in want.items() if d}
    assert met[0] < 0.25 * sum(len(held.get(w, ())) for _, text in rows for w in set(text.split()))


def test_parts_of_a_batch_do_not_change_postings(monkeypatch):
    import pyarrow as pa

    texts = [[None, ["", "b a", "zz a a", "ü"][i % 4], ["a", ""][i % 2], "x " * (i % 9)] for i in range(40)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([None, *range(1, 40)]), *[pa.array([(t[n] or "").strip() for t in texts]) for n in (1, 2, 3)]],
        names=["doc_id", "_0", "_1", "_2"],
    )

    def postings(size):
        monkeypatch.setattr(lexical, "COUNTED_BYTES", size)
        parts = [p.to_pylist() for p in lexical._count_terms([3.0, 2.0, 1.0], "doc_id")([batch, batch.slice(0, 0)])]
        return len(parts), sorted(
            (str(h["doc_id"]), h["doc_len"], b["term"], h["wtf"], h["tf"]) for p in parts for b in p for h in b["held_by"]
        )

    (few, whole), (many, cut) = postings(10**6), postings(1)
    assert few < many and whole == cut
    assert [p for p in whole if p[0] == "2"] == [("2", 6, "a", 8.0, 3), ("2", 6, "x", 2.0, 2), ("2", 6, "zz", 3.0, 1)]


def test_index_files_are_sorted_by_term(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame(zipf_corpus(1, 200), "doc_id bigint, title string, skills string, summary string")
    index = lexical.write_index(docs, str(tmp_path / "index"))
    files = list((tmp_path / "index" / "postings").rglob("*.parquet"))
    assert len(files) >= index.buckets // 2
    for file in files:
        terms = pq.read_table(str(file), columns=["term", "class"], partitioning=None).to_pylist()
        keys = [(t["term"].encode(), t["class"]) for t in terms]
        assert keys == sorted(keys)
