import numpy as np
import pytest

from searchlab.llm import count_tree as C
from searchlab.llm.minhash import shingle_set
from tests.llm.cases import edge_documents, no_documents, small_documents


def brute_force(rows, words=3, percent=90):
    """rows: (id, text); one row's id may repeat. Sets are made word by word here."""
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
        k = min(words, len(found))
        sets.append(frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1)) if found else frozenset())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if a and b and (same_id or 100 * len(a & b) >= percent * len(a | b)):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(
        ((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr
    )


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in C.jaccard_components(df, **more).collect()), key=repr)


def changed(random, words, n):
    out = list(words)
    for at in random.choice(len(words), n, replace=False):
        out[at] = f"x{random.integers(1 << 40)}"
    return " ".join(out)


def family(seed, size, length, most):
    random = np.random.default_rng(seed)
    words = [f"w{seed}x{i}" for i in range(length)]
    return [changed(random, words, int(random.integers(0, most + 1))) for _ in range(size)]


def numbered(texts, first=1):
    return [(first + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [50, 80, 90, 99])
def test_every_linked_pair_shares_a_bucket(percent):
    random = np.random.default_rng(percent)
    for n in [1, 2, 5, 9, 10, 11, 19, 20, 40, 100, 333, 1500]:
        for _ in range(20):
            whole = np.unique(random.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            other = whole[random.random(len(whole)) > random.random() * (100 - percent) / 100]
            fresh = np.unique(random.integers(0, 2**63, max(1, int(random.random() * n * (100 - percent) / 150)), dtype=np.uint64))
            other = np.union1d(other, fresh if random.random() < 0.6 else other)
            shared = len(np.intersect1d(whole, other))
            if 100 * shared >= percent * (len(whole) + len(other) - shared) and not np.array_equal(whole, other):
                assert np.intersect1d(C.bucket_keys(whole, percent), C.bucket_keys(other, percent)).size


def test_bound_is_never_below_the_overlap():
    one, two = (shingle_set(t, 2) for t in ("a b c d e f " * 40 + "g h", "a b c d e g h i j " * 90))
    points = [C.unpacked(C.packed(C.point(x))) for x in (one, two)]
    assert np.minimum(*points).sum() >= len(np.intersect1d(one, two)) > 0
    assert [int(p.sum()) for p in points] == [len(one), len(two)]


def test_points_with_many_shingles_of_one_group_keep_their_counts():
    counts = np.zeros(C.GROUPS, np.int64)
    counts[3] = 70_000
    assert np.array_equal(C.unpacked(C.packed(counts)), counts)


@pytest.mark.parametrize("seed", range(6))
def test_tree_pairs_equal_all_pairs(seed):
    random = np.random.default_rng(seed)
    n = 150
    base = random.poisson(3, (5, C.GROUPS))
    points = base[random.integers(0, 5, n)] + random.poisson(0.15, (n, C.GROUPS))
    sizes, comps = points.sum(axis=1), random.integers(0, 40, n)
    tree = C.Tree(points, sizes, comps)
    common = np.minimum(points[:, None], points[None]).sum(axis=2)
    good = C._reach(common, sizes[:, None], sizes[None], 90) & (comps[:, None] != comps[None])
    want = {(i, j) for i, j in zip(*np.nonzero(good)) if i < j}
    a, b, most = C.tree_pairs(tree, tree, 90)
    assert {(min(i, j), max(i, j)) for i, j in zip(a, b)} == want and len(a) == len(want) > 0
    assert np.array_equal(most, common[a, b])
    one, two = (C.Tree(points[s], sizes[s], comps[s]) for s in (slice(0, 60), slice(60, n)))
    a, b, _ = C.tree_pairs(one, two, 90)
    assert {(i, j + 60) for i, j in zip(a, b)} == {(i, j) for i, j in want if i < 60 <= j}


def test_small_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in small_documents(spark).collect()]
    rows += numbered(family(1, 60, 150, 6), 10_000) + numbered(family(2, 40, 40, 2), 20_000)
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("page", [1024, 8])
def test_families_in_pages(spark, monkeypatch, page):
    monkeypatch.setattr(C, "PAGE", page)
    rows = numbered(family(3, 120, 100, 4)) + numbered(family(4, 60, 700, 20), 500) + numbered(family(5, 30, 12, 1), 900)
    got = found(spark, rows)
    assert got == brute_force(rows)
    assert 1 < len({c for _, _, c in got}) < 200


@pytest.mark.parametrize("words, percent", [(1, 70), (2, 80), (5, 100)])
def test_other_thresholds(spark, words, percent):
    rows = numbered(family(6, 60, 60, 6)) + numbered(family(7, 30, 9, 2), 500)
    assert found(spark, rows, words=words, percent=percent) == brute_force(rows, words, percent)


def test_texts_of_one_id_are_one_document(spark):
    random = np.random.default_rng(8)
    one, two = ([f"{c}{i}" for i in range(100)] for c in "ab")
    rows = [(1, " ".join(one)), (2, changed(random, one, 1)), (2, " ".join(two)), (3, changed(random, two, 1)), (4, "other")]
    got = found(spark, rows)
    assert got == brute_force(rows)
    assert {(d, c) for d, _, c in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_rows_without_id_link_others(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[: 120 - 5 * i]) for i in range(4)]
    rows = [(7, texts[0]), (None, texts[1]), (8, texts[2]), (None, "alone"), (None, None)]
    got = found(spark, rows)
    assert got == brute_force(rows)
    assert (8, 108, 7) in got and (None, 113, 7) in got and (None, 1, None) in got and (None, 0, None) in got


def test_edge_documents(spark):
    df = edge_documents(spark)
    got = sorted((tuple(r) for r in C.jaccard_components(df).collect()), key=repr)
    assert got == brute_force([(r.doc_id, r.text) for r in df.collect()])
    assert C.jaccard_components(no_documents(spark)).collect() == []
