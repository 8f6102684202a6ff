import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlab.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>, anchor string, g string, rank string"


def brute_force(rows, positives=5, negatives=10):
    """rows: (id, label, vector), clean; anchors have ids divisible by 100."""
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows]
    out, done = [], set()
    for i, label, v in sorted(whole):
        if i % 100 or i in done:
            continue
        done.add(i)
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in whole if j != i)
        for least, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and -30 * least <= -100 * s[0] <= -90 * least]
            out += [(i, j, rank + 1, s[1], -least, -s[0]) for rank, s in enumerate(fits[:negatives])]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (9, 9, 9), (17, 64, 33), (40, 7, 100), (65, 13, 31), (0, 5, 4), (5, 0, 4)])
def test_strassen_equals_the_product(shape):
    r, k, c = shape
    random = np.random.default_rng(sum(shape))
    a, b = random.integers(-(2**28), 2**28, (r, k)), random.integers(-(2**28), 2**28, (k, c))
    assert np.array_equal(H.strassen(a, b), a @ b)


def test_best_places_takes_the_first_of_equal_ones():
    scores = np.array([[5, 7, 5, 5, 1], [H.NOTHING, 3, H.NOTHING, 3, 3], [H.NOTHING] * 5])
    r, c = H.best_places(scores, 2)
    assert list(zip(r, c)) == [(0, 0), (0, 1), (1, 1), (1, 3)]


def test_heaps_merge_in_any_order():
    random = np.random.default_rng(3)
    owner, score, id_ = random.integers(0, 4, 300), random.integers(0, 9, 300), random.permutation(300)
    whole, parts = H.Heaps(7), H.Heaps(7)
    whole.merge(owner, score, id_)
    for at in range(0, 300, 37):
        parts.merge(*(x[at : at + 37] for x in (owner, score, id_)))
    for name in ("owner", "score", "id"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name))


@pytest.mark.parametrize("score", [-1001, -7, 0, 1, 3, 10, 333, 2**61])
def test_window_ends(score):
    least, most = (int(x) for x in H.window_ends(np.int64(score), 30, 90))
    assert 30 * score <= 100 * least < 30 * score + 100
    assert 90 * score - 100 < 100 * most <= 90 * score


def test_random_vectors_with_ties_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE", (3, 16))
    monkeypatch.setattr(H, "CANDIDATE_BLOCK", (32, 64))
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 2)
    random = np.random.default_rng(11)
    rows = [(100 * i if i < 6 else 1000 + i, int(random.integers(0, 3)), [float(x) / 8 for x in random.integers(-3, 4, 11)]) for i in range(300)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    assert mined(df) == brute_force(rows)


def test_rows_that_take_no_part_ragged_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [2.0]), (2, 1, []), (3, 2, [1.0, 0.5, 9.0]), (4, 2, [1.0]), (4, 2, [1.0]),
        (5, 1, [1.5, 1.0]), (6, 2, [0.5, 0.1]), (7, 2, [-1.0, 1.0]),
    ]
    bad = [
        (8, None, [9.0, 9.0]), (9, 1, None), (10, 1, [nan, 1.0]), (11, 2, [inf, 1.0]), (12, 2, [None, 1.0]),
        (None, 1, [9.0, 9.0]), (100, 1, None),
    ]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows + bad], SCHEMA)
    assert mined(df) == brute_force(rows)


def test_repeated_anchor_and_its_copies(spark):
    rows = [(0, 1, [1.0]), (0, 2, [3.0]), (0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert mined(df) == [(0, 1, 1, 2, 65536, 32768)]


def test_one_vector_for_all_rows(spark):
    rows = [(i, i % 2, [0.5, 0.5]) for i in range(250)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert mined(df) == brute_force(rows) == []
    half = [(i, i % 2, [0.5, 0.5] if i % 2 == 0 else [0.25, 0.5]) for i in range(250)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in half], SCHEMA)
    assert mined(df) == brute_force(half) != []


def test_empty_tables_and_scores_beyond_64_bits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0], "x", "y", "z")], SCHEMA)) == []
    far = spark.createDataFrame([(0, 1, [2.0**45], "x", "y", "z"), (1, 1, [2.0**45], "x", "y", "z")], SCHEMA)
    with pytest.raises(Exception, match="64-bit"):
        mined(far)
