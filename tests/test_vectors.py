"""Exact, approximate and reduced search against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlab.functions.vectors import unit_vector
from searchlab.operators import ann, reduction
from searchlab.operators.dense import exact_top_k

DIM = 12


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    docs = unit(rng.normal(size=(400, DIM)))
    docs[::3] = docs[0]  # a third of all vectors are copies
    return docs, unit(rng.normal(size=(9, DIM)))


@pytest.fixture(scope="module")
def frames(spark, data):
    docs, asked = data
    vectors = spark.createDataFrame(
        [(f"d{i:04}", v.tolist()) for i, v in enumerate(docs)], "doc_id string, embedding array<double>"
    ).repartition(5)
    queries = spark.createDataFrame(
        [(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "query_id string, qvec array<double>"
    )
    return vectors, queries


def brute(docs, asked, k, allowed=None):
    want = {}
    for q, vector in enumerate(asked):
        scores = np.round(docs @ vector, 6)
        ids = [i for i in range(len(docs)) if allowed is None or i in allowed[q]]
        ids.sort(key=lambda i: (-scores[i], i))
        want[f"q{q}"] = [(f"d{i:04}", float(scores[i])) for i in ids[:k]]
    return want


def lists(run, key="query_id"):
    got = {}
    for row in sorted(run.collect(), key=lambda r: r["rank"]):
        got.setdefault(row[key], []).append((row["doc_id"], row["score"]))
    return got


def close(got, want):
    assert got.keys() == want.keys()
    for query in want:
        assert [d for d, _ in got[query]] == [d for d, _ in want[query]]
        assert np.allclose([s for _, s in got[query]], [s for _, s in want[query]], atol=1e-6)


@pytest.mark.parametrize("k", [1, 10, 250])
def test_exact(frames, data, k):
    close(lists(exact_top_k(*frames, k=k)), brute(*data, k))


@pytest.mark.parametrize("block_bytes", [500, 5_000, 10**7])
def test_blocked_form_is_the_same(frames, data, block_bytes):
    found = exact_top_k(*frames, k=10, broadcast_bytes=0, block_bytes=block_bytes)
    close(lists(found), brute(*data, 10))


def test_bounded_products_give_the_same(frames, data, monkeypatch):
    from searchlab.operators import dense

    monkeypatch.setattr(dense, "PRODUCT_NUMBERS", 200)
    close(lists(exact_top_k(*frames, k=10)), brute(*data, 10))


def test_empty_sides(frames):
    vectors, queries = frames
    assert exact_top_k(vectors, queries.limit(0)).count() == 0
    assert exact_top_k(vectors.limit(0), queries).count() == 0
    blocked = exact_top_k(vectors.limit(0), queries, broadcast_bytes=0)
    assert blocked.count() == 0


def test_fewer_vectors_than_k(frames):
    vectors, queries = frames
    assert exact_top_k(vectors.filter("doc_id < 'd0003'"), queries).count() == 27


def test_vectors_of_different_width_are_refused(spark, frames):
    ragged = spark.createDataFrame(
        [("a", [1.0] * DIM), ("b", [1.0])], "doc_id string, embedding array<double>"
    ).coalesce(1)
    with pytest.raises(Exception, match="different dimensions"):
        exact_top_k(ragged, frames[1]).collect()


def test_result_does_not_depend_on_partitions(frames):
    vectors, queries = frames
    one = lists(exact_top_k(vectors.coalesce(1), queries))
    assert one == lists(exact_top_k(vectors.repartition(13), queries))


def cells_of(data, pivots):
    docs, asked = data
    nearest = lambda m: np.argsort(-np.round(m @ pivots.T, 6), axis=1, kind="stable")
    return nearest(docs)[:, 0], nearest(asked)


@pytest.mark.parametrize("broadcast_bytes", [2**26, 0])
def test_cells(spark, frames, data, broadcast_bytes):
    vectors, queries = frames
    centroids = ann.pivot_centroids(vectors.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("long")), 6)
    rows = sorted(centroids.collect(), key=lambda r: r["cell"])
    doc_cells, order = cells_of(data, np.array([r["centroid"] for r in rows]))
    assigned = ann.assign_cells(vectors, centroids)
    got = {r["doc_id"]: r["cell"] for r in assigned.collect()}
    assert got == {f"d{i:04}": rows[c]["cell"] for i, c in enumerate(doc_cells)}

    found = ann.search_cells(
        assigned, queries, centroids, [1, 3, 6], 10,
        broadcast_bytes=broadcast_bytes, block_bytes=2_000,
    ).cache()
    for nprobe in (1, 3, 6):
        allowed = [
            {i for i, c in enumerate(doc_cells) if c in set(order[q][:nprobe])} for q in range(9)
        ]
        close(lists(found.filter(F.col("nprobe") == nprobe)), brute(*data, 10, allowed))

    exact = exact_top_k(vectors, queries, k=10)
    recall = {r["nprobe"]: r["ann_recall_at_10"] for r in ann.recall_against_exact(exact, found).collect()}
    assert recall[6] == 1.0  # every cell visited
    assert recall[1] <= recall[3] <= 1.0


@pytest.mark.parametrize("broadcast_bytes", [2**26, 0])
def test_projection_buckets(spark, frames, data, broadcast_bytes):
    docs, asked = data
    directions = unit(np.random.default_rng(3).normal(size=(3, DIM)))
    axes = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(directions)], "cell bigint, centroid array<double>"
    )
    code = lambda m: np.floor(np.round(m @ directions.T, 6) / 0.3)
    allowed = [set(np.flatnonzero((code(docs) == row).any(axis=1))) for row in code(asked)]
    buckets = ann.assign_projection_buckets(frames[0], axes, 0.3)
    found = ann.search_projection_buckets(
        buckets, frames[1], axes, 0.3, 10, broadcast_bytes=broadcast_bytes, block_bytes=2_000
    )
    close(lists(found), brute(docs, asked, 10, allowed))


def test_cell_files(spark, frames, tmp_path):
    vectors, queries = frames
    numbered = vectors.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("long"))
    centroids = ann.pivot_centroids(numbered, 4)
    assigned = ann.assign_cells(numbered, centroids)
    ann.write_cells(assigned, str(tmp_path / "cells"))
    saved = ann.read_cells(spark, str(tmp_path / "cells"))
    search = lambda cells: lists(ann.search_cells(cells, queries, centroids, [2], 5))
    assert search(saved) == search(assigned)
    plan = saved.filter(F.col("cell").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(" in plan


def test_search_reads_only_the_folders_of_visited_cells(spark, frames, tmp_path):
    """The others' files are gone, and the search does not miss them."""
    import shutil

    vectors, queries = frames
    centroids = ann.pivot_centroids(vectors, 6)
    ann.write_cells(ann.assign_cells(vectors, centroids), str(tmp_path / "cells"))
    asked = queries.limit(1)
    search = lambda: ann.search_cells(ann.read_cells(spark, str(tmp_path / "cells")), asked, centroids, [1, 2], 5)
    plan = search()._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    before = lists(search())
    routed = ann.route_queries(asked, centroids, [1, 2]).collect()
    assert sorted(r.setting for r in routed) == [0, 1]
    folders = {int(p.name.removeprefix("cell=")): p for p in (tmp_path / "cells").glob("cell=*")}
    left = set(folders) - {r.cell for r in routed}
    assert left
    kept = ann.read_cells(spark, str(tmp_path / "cells"))
    for cell in left:
        shutil.rmtree(folders[cell])
    assert lists(ann.search_cells(kept, asked, centroids, [1, 2], 5)) == before


def test_best_cells_takes_the_first_of_equal_ones():
    rows, centroids = np.eye(3), np.array([[1.0, 0, 0], [0, 1, 0], [1, 0, 0], [0.5, 1, 0], [1, 0, 1]])
    assert ann._best_cells(rows, centroids, 2).tolist() == [[0, 2], [1, 3], [4, 0]]
    assert ann._best_cells(rows, centroids, 9).tolist()[0] == [0, 2, 4, 3, 1]


def test_one_projection_serves_all_dimensions(frames):
    model, _ = reduction.fit_pca(frames[0], 5)
    cut = reduction.project_dimensions(frames[0], model, [2, 4, 4])
    for dim in (2, 4):
        got = {r["doc_id"]: r["embedding"] for r in cut.filter(F.col("dim") == dim).collect()}
        want = {r["doc_id"]: r["embedding"] for r in reduction.project(frames[0], model, dim).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[d], want[d]) for d in want)


def test_recall_keeps_k_as_denominator(spark):
    exact = spark.createDataFrame([("q", f"d{i}", i + 1) for i in range(10)], "query_id string, doc_id string, rank int")
    four = exact.filter("rank <= 4").withColumn("nprobe", F.lit(1))
    assert ann.recall_against_exact(exact, four).first()["ann_recall_at_10"] == 0.4


def test_kmeans_visiting_all_cells_is_exact(frames, data):
    vectors, queries = frames
    centers = ann.kmeans_centroids(vectors, 5)
    found = ann.search_cells(ann.assign_cells(vectors, centers), queries, centers, [5], 10)
    close(lists(found), brute(*data, 10))


def test_zero_vector_stays_zero(spark):
    zeros = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in zeros.select(unit_vector(F.col("v"))).collect()] == [[0, 0], [0.6, 0.8]]


def test_pca_matches_svd(spark, frames, data):
    docs, _ = data
    model, rows = reduction.fit_pca(frames[0], 5)
    assert rows == 400
    centred = docs - docs.mean(axis=0)
    _, singular, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.ratios, (singular**2 / (singular**2).sum())[:5])
    assert np.allclose(np.abs(np.sum(model.components * axes[:5], axis=1)), 1)
    small = {r["doc_id"]: r["embedding"] for r in reduction.project(frames[0], model, 3).collect()}
    want = unit(centred @ model.components[:3].T)
    got = np.array([small[f"d{i:04}"] for i in range(400)])
    assert np.allclose(got, want)


def test_explained_variance_grows_to_one(spark, frames):
    model, _ = reduction.fit_pca(frames[0], DIM - 1)
    rows = reduction.explained_variance(spark, model).orderBy("component").collect()
    running = [r["cumulative_explained_variance_ratio"] for r in rows]
    assert running == sorted(running)
    assert 0.9 < running[-1] <= 1 + 1e-9


def test_projection_survives_saving(spark, frames, tmp_path):
    model, _ = reduction.fit_pca(frames[0], 4)
    reduction.save_projection(spark, model, str(tmp_path / "pca"))
    again = reduction.load_projection(spark, str(tmp_path / "pca"))
    assert np.array_equal(model.components, again.components)
    assert np.array_equal(model.mean, again.mean)


def test_parameters_are_checked(spark, frames):
    vectors, _ = frames
    with pytest.raises(ValueError):
        reduction.fit_pca(vectors, DIM)
    model, _ = reduction.fit_pca(vectors, 4)
    with pytest.raises(ValueError):
        reduction.project(vectors, model, 5)
    with pytest.raises(ValueError):
        reduction.reduction_report(vectors, [4, 0])
    with pytest.raises(ValueError):
        exact_top_k(*frames, k=0)


@pytest.mark.parametrize("broadcast_bytes", [2**26, 0])
def test_cells_of_cells(spark, frames, data, broadcast_bytes):
    vectors, queries = frames
    numbered = vectors.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("long"))
    centroids = ann.pivot_centroids(numbered, 12)
    tops, leaves = ann.cell_tree(centroids, 4)
    heads = {r["cell"]: np.array(r["centroid"]) for r in tops.collect()}
    group = {r["leaf"]: r["cell"] for r in leaves.collect()}
    center = {r["leaf"]: np.array(r["centroid"]) for r in leaves.collect()}
    assert len(group) == 12 and set(group.values()) == set(heads)

    def ordered(vector, among):
        return sorted(among, key=lambda c: (-round(float(vector @ among[c]), 9), c))

    def visits(vector, beam):
        groups = ordered(vector, heads)[:beam]
        return ordered(vector, {c: center[c] for c in center if group[c] in groups})

    docs, asked = data
    for beam in (2,) if broadcast_bytes else (9,):
        assigned = ann.assign_tree_cells(vectors, tops, leaves, beam, block_bytes=20_000)
        cells = {r["doc_id"]: r["cell"] for r in assigned.collect()}
        assert cells == {f"d{i:04}": visits(v, beam)[0] for i, v in enumerate(docs)}
        found = ann.search_cell_tree(
            assigned, queries, tops, leaves, [1, 3, 12], 10, beam,
            broadcast_bytes=broadcast_bytes, block_bytes=20_000,
        ).cache()
        for nprobe in (1, 3, 12):
            allowed = [
                {i for i in range(len(docs)) if cells[f"d{i:04}"] in visits(q, beam)[:nprobe]} for q in asked
            ]
            close(lists(found.filter(F.col("nprobe") == nprobe)), brute(*data, 10, allowed))


def test_cells_of_cells_read_only_visited_folders(frames, tmp_path):
    vectors, queries = frames
    numbered = vectors.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("long"))
    tops, leaves = ann.cell_tree(ann.pivot_centroids(numbered, 12), 4)
    ann.write_cells(ann.assign_tree_cells(vectors, tops, leaves), str(tmp_path / "cells"))
    saved = ann.read_cells(vectors.sparkSession, str(tmp_path / "cells"))
    found = ann.search_cell_tree(saved, queries, tops, leaves, [2])
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString()
    assert ann.search_cell_tree(saved, queries.limit(0), tops, leaves, [2]).count() == 0
    with pytest.raises(ValueError, match="nprobe"):
        ann.search_cell_tree(saved, queries, tops, leaves, [])


def test_refined_centroids(frames, data):
    vectors, _ = frames
    docs, _ = data
    numbered = vectors.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("long"))
    # A head that no vector is nearest to keeps its place.
    far = -10 * docs.sum(axis=0)
    start = ann.pivot_centroids(numbered, 4).collect()
    rows = [(r["cell"], list(r["centroid"])) for r in start] + [(10**6, (far * 1e-9).tolist())]
    centroids = vectors.sparkSession.createDataFrame(rows, "cell bigint, centroid array<double>")
    want = {c: np.array(v) for c, v in rows}
    cells = sorted(want)
    for _ in range(2):
        nearest = (docs @ np.array([want[c] for c in cells]).T).argmax(axis=1)
        for place, cell in enumerate(cells):
            if (nearest == place).any():
                want[cell] = unit(docs[nearest == place].mean(axis=0, keepdims=True))[0]
    got = {r["cell"]: r["centroid"] for r in ann.refined_centroids(vectors, centroids, 2).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[c], want[c]) for c in cells)
