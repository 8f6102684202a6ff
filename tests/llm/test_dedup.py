import hashlib
from collections import defaultdict

from searchlab.llm import minhash, radix_dedup
from searchlab.llm.components import components
from tests.llm.cases import ROWS, edge_documents, no_documents, small_documents


def expected_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=repr)


def test_exact_groups_edge_rows(spark):
    got = [tuple(r) for r in radix_dedup.exact_groups(edge_documents(spark)).collect()]
    assert sorted(got, key=repr) == expected_exact(ROWS)


def test_exact_groups_split_at_every_level(spark):
    base = "x" * 5000
    texts = [base[:n] for n in (0, 1, 63, 64, 65, 511, 512, 513, 4096, 4097)] * 2
    texts += [base[:n] + "é" for n in (62, 63, 64, 511, 575, 576, 577)] * 2
    rows = list(enumerate(texts))
    got = radix_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_exact(rows)


def test_keep_largest_keeps_columns_and_one_row_of_each_text(spark):
    docs = edge_documents(spark)
    kept = radix_dedup.keep_largest(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len({text or "" for _, text in ROWS})
    assert {r[0] for r in rows if r[1] and r[1].startswith("a b c")} == {4}
    assert {r[0] for r in rows if not r[1]} == {3}


def test_no_documents(spark):
    assert radix_dedup.exact_groups(no_documents(spark)).count() == 0
    assert minhash.near_duplicates(no_documents(spark)).count() == 0


def brute_force(rows, words):
    sets = {}
    for doc_id, text in rows:
        found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for space in "\t\n\v\f\r":
            found = found.replace(space, " ")
        found = [w for w in found.split(" ") if w]
        k = min(words, len(found))
        sets[doc_id] = {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_near_duplicates_equal_brute_force(spark):
    docs = small_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # A family of copies that are near the original but not near each other.
    words = [f"w{i}" for i in range(40)]
    for number in range(30):
        changed = list(words)
        for at in (number, (number * 7 + 3) % 40):
            changed[at] = f"other{number}x{at}"
        rows.append((10_000 + number, " ".join(changed)))
    rows.append((9_999, " ".join(words)))
    rows.append((9_998, " ".join(words[:33])))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_force(rows, 2)


def test_near_duplicates_edge_rows(spark):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(edge_documents(spark)).collect()}
    assert got[(4, 3)] == (1, False) and got[(1, 3)] == (1, True)
    assert got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True) and got[(8, 0)] == (8, True)
    assert got[(6, 3)] == (5, False)
    assert got[(None, 1)] == (None, False) and got[(None, 0)] == (None, False)
    assert got[(10, 1)] == (10, True)


def test_keep_one_of_each_keeps_columns_and_null_ids(spark):
    docs = edge_documents(spark)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 4 not in ids and 6 not in ids and 1 in ids and 5 in ids


def test_posterior_limits_keep_pairs_at_the_threshold():
    limits = minhash.least_matches()
    assert list(limits) == [32, 64, 96, 128, 160]
    assert all(0 < m < 0.8 * n for n, m in limits.items())
    assert limits[160] / 160 > limits[32] / 32


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (100, 50), (300, 200)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert {got[i] for i in range(1, 41)} == {1}
    assert {got[i] for i in range(100, 160)} | {got[50]} == {50}
    assert got[300] == 200 and len(got) == 40 + 61 + 2
    assert components(links.filter("a < 0")).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(one)), (2, " ".join(one[1:])), (2, " ".join(two)), (3, " ".join(two[:-1])), (4, "x y z")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}
    assert len(got) == 5


def test_rows_without_id_link_others(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(7, " ".join(words)), (None, " ".join(words[:90])), (8, " ".join(words[:81])), (None, "alone here")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 7), (8, 7), (None, 7), (None, None)}
