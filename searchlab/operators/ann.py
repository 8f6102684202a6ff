"""Approximate search over cells (inverted file), its sweep and its recall.

Every vector belongs to the cell of its best centroid; a query visits the
``nprobe`` best cells and is scored exactly inside. Saved with ``partitionBy("cell")``
the table is read only where a query goes. Scoring never groups by cell, so a cell
that holds a large share of all vectors is read by many tasks. Centroids that are too
many to send to every task are put in groups around some of them (``cell_tree``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from searchlab.functions.vectors import unit_vector
from searchlab.operators.dense import (
    BLOCK_BYTES,
    BROADCAST_BYTES,
    Routes,
    best_rows,
    matrix_within,
    search_in_blocks,
    search_with_broadcast,
    small_matrix,
    to_matrix,
)
from searchlab.operators.sampling import SEED, fixed_size_sample
from searchlab.operators.topk import rank_top_k
from searchlab.sources.staging import stage

VISIT_BYTES = 24  # of one visit of a query to a cell
BEAM = 4  # groups of cells that are looked at


def pivot_centroids(
    vectors: DataFrame, cells: int, id_col: str = "doc_id", vec_col: str = "embedding"
) -> DataFrame:
    """``cells`` sampled vectors as centroids; repeatable.

    A cell has the number of its vector; where ids are no whole numbers, the sampled
    vectors (at most ``cells``) are numbered in the order of their ids.
    """
    sample = fixed_size_sample(vectors.select(id_col, vec_col), cells, [id_col], allow_fewer=True)
    if not isinstance(sample.schema[id_col].dataType, T.IntegralType):
        place = F.row_number().over(Window.orderBy(id_col)).cast("long")
        sample = sample.withColumn(id_col, place)
    return sample.select(F.col(id_col).alias("cell"), F.col(vec_col).alias("centroid"))


def kmeans_centroids(
    vectors: DataFrame,
    cells: int,
    id_col: str = "doc_id",
    vec_col: str = "embedding",
    sample_size: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Cosine k-means centroids, fitted on all vectors or on a sample of ``sample_size``."""
    rows = vectors.select(id_col, vec_col)
    if sample_size is not None:
        rows = fixed_size_sample(rows, sample_size, [id_col], seed, allow_fewer=True)
    # ``persist`` recomputes lost partitions.
    points = rows.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    points = points.persist()
    try:
        model = KMeans(k=cells, seed=seed, distanceMeasure="cosine").fit(points)
    finally:
        points.unpersist()
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centers, "cell bigint, centroid array<double>")


def refined_centroids(
    vectors: DataFrame, centroids: DataFrame, rounds: int = 2, vec_col: str = "embedding"
) -> DataFrame:
    """Centroids moved to the unit mean of their cells, ``rounds`` times; an empty cell keeps its own.

    Means are combined in every task before the shuffle, so a large cell costs no more than others.
    """
    for _ in range(rounds):
        features = array_to_vector(F.col(vec_col).cast("array<double>"))
        means = (
            assign_cells(vectors.select(vec_col), centroids, vec_col)
            .groupBy("cell")
            .agg(vector_to_array(Summarizer.mean(features)).alias("mean"))
        )
        moved = F.coalesce(unit_vector(F.col("mean")), F.col("centroid").cast("array<double>"))
        centroids = stage(
            centroids.join(means, "cell", "left").select("cell", moved.alias("centroid")), "moved"
        )
    return centroids


def _best_cells(rows: np.ndarray, centroids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the ``depth`` best centroids per row, ties to the lower cell."""
    return best_rows(rows, centroids, depth)[0]


def assign_cells(
    vectors: DataFrame, centroids: DataFrame, vec_col: str = "embedding"
) -> DataFrame:
    """Adds ``cell``: the centroid of the largest inner product. No shuffle."""
    keys, matrix = small_matrix(centroids, ["cell"], "centroid")
    cells = keys["cell"].to_numpy()
    shared = vectors.sparkSession.sparkContext.broadcast((cells, matrix))
    position = vectors.columns.index(vec_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, matrix = shared.value
        for batch in batches:
            if batch.num_rows:
                nearest = _best_cells(to_matrix(batch.column(position)), matrix, 1)[:, 0]
                yield batch.append_column("cell", pa.array(cells[nearest], pa.int64()))

    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.LongType())])
    return vectors.mapInArrow(assign, schema)


def _first_settings(probes: list[int]) -> np.ndarray:
    """For each visit of a query the first setting (place in sorted ``probes``) that makes it."""
    return np.searchsorted(probes, np.arange(1, probes[-1] + 1))


def route_queries(
    queries: DataFrame, centroids: DataFrame, probes: list[int], query_vec: str = "qvec"
) -> DataFrame:
    """One row per query and visited cell, with the ``setting`` that visits it first."""
    keys, matrix = small_matrix(centroids, ["cell"], "centroid")
    cells = keys["cell"].to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((cells, matrix))
    position = queries.columns.index(query_vec)
    depth = min(probes[-1], len(cells))
    settings = F.array(*[F.lit(int(x)) for x in _first_settings(probes)[:depth]])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, matrix = shared.value
        for batch in batches:
            if batch.num_rows:
                order = cells[_best_cells(to_matrix(batch.column(position)), matrix, depth)]
                yield batch.append_column(
                    "_cells", pa.array(order.tolist(), pa.list_(pa.int64()))
                )

    schema = T.StructType(
        [*queries.schema.fields, T.StructField("_cells", T.ArrayType(T.LongType()))]
    )
    return (
        queries.mapInArrow(route, schema)
        .select("*", F.posexplode("_cells").alias("_visit", "cell"))
        .withColumn("setting", F.get(settings, F.col("_visit")))
        .drop("_cells", "_visit")
    )


def search_cells(
    assigned: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    probes: list[int],
    k: int = 20,
    doc_col: str = "doc_id",
    vec_col: str = "embedding",
    query_col: str = "query_id",
    query_vec: str = "qvec",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(query, nprobe, doc, score, rank)`` for all values of ``nprobe`` in one job.

    Every product is made once, at the deepest setting. A query keeps a list of its best for the visits
    that each setting adds; the lists of a setting and of the smaller ones hold its result. The
    visited cells are a staged table: of cells saved with ``write_cells`` only those are read.
    """
    probes = sorted(set(probes))
    if not probes or probes[0] <= 0:
        raise ValueError("nprobe must be positive")
    query_cols = [query_col, "setting"]
    schema = T.StructType(
        [
            queries.schema[query_col],
            T.StructField("setting", T.IntegerType()),
            assigned.schema[doc_col],
            T.StructField("score", T.DoubleType()),
        ]
    )
    fetched = _small_queries(queries, query_col, query_vec, probes, broadcast_bytes)
    if fetched is None:
        routed = route_queries(queries.select(query_col, query_vec), centroids, probes, query_vec)
        scored = search_in_blocks(
            assigned, routed, schema, k, doc_col, vec_col, query_cols, query_vec, block_bytes
        )
    else:
        keys, matrix = fetched
        cell_keys, centers = small_matrix(centroids, ["cell"], "centroid")
        order = cell_keys["cell"].to_numpy()[_best_cells(matrix, centers, probes[-1])]
        rows = np.repeat(np.arange(len(matrix)), order.shape[1])
        visits = np.tile(np.arange(order.shape[1]), len(matrix))
        scored = _scored_visits(
            assigned, keys, matrix, order.ravel(), rows, visits, probes, schema, k, doc_col, vec_col
        )
    return _ranked_settings(scored, probes, k, query_col, doc_col)


def _small_queries(
    queries: DataFrame, query_col: str, query_vec: str, probes: list[int], limit: int
) -> tuple[pa.Table, np.ndarray] | None:
    """Keys and matrix of the queries; None where they or their visits are above ``limit`` bytes."""
    fetched = matrix_within(queries, [query_col], query_vec, limit // len(probes))
    if fetched is None or len(fetched[1]) * probes[-1] * VISIT_BYTES > limit:
        return None
    return fetched


def _scored_visits(
    assigned: DataFrame,
    keys: pa.Table,
    matrix: np.ndarray,
    cells: np.ndarray,
    rows: np.ndarray,
    visits: np.ndarray,
    probes: list[int],
    schema: T.StructType,
    k: int,
    doc_col: str,
    vec_col: str,
) -> DataFrame:
    """Products of the queries ``rows`` with the vectors of the ``cells`` that they visit."""
    spark = assigned.sparkSession
    first = _first_settings(probes)[visits]
    routes = Routes.of(cells, rows, first * len(matrix) + rows)
    visited = spark.createDataFrame(
        pa.table({"cell": routes.cells, "visits": np.diff(routes.starts)})
    )
    # The predicate holds for every row; partition pruning at run time asks for one.
    visited = stage(visited.coalesce(1), "visited_cells").filter(F.col("visits") > 0)
    settings = pa.array(np.repeat(np.arange(len(probes)), len(matrix)), pa.int32())
    return search_with_broadcast(
        assigned.join(visited, "cell", "left_semi"),
        pa.concat_tables([keys] * len(probes)).append_column("setting", settings),
        matrix, schema, k, doc_col, vec_col, routes,
    )


def _ranked_settings(
    scored: DataFrame, probes: list[int], k: int, query_col: str, doc_col: str
) -> DataFrame:
    """Results of every setting: those of its own list and of the smaller ones."""
    later = F.slice(F.array(*[F.lit(p).cast("long") for p in probes]), F.col("setting") + 1, F.lit(len(probes)))
    found = scored.withColumn("nprobe", F.explode(later)).select(query_col, "nprobe", doc_col, "score")
    return rank_top_k(found, k, [query_col, "nprobe"], doc_col)


def cell_tree(centroids: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """Cells of cells, for centroids too many to send to every task.

    ``groups`` sampled centroids head a group each, and a centroid belongs to the group of its best
    head. Returned: ``tops(cell, centroid)``, the heads of groups that are not empty, and
    ``leaves(leaf, centroid, cell)``, all centroids with their group.
    """
    leaves = centroids.select(F.col("cell").alias("leaf"), "centroid")
    tops = pivot_centroids(leaves, groups, "leaf", "centroid")
    leaves = stage(assign_cells(leaves, stage(tops, "heads"), "centroid"), "leaves")
    return stage(tops.join(leaves.select("cell").distinct(), "cell", "left_semi"), "tops"), leaves


def nearest_leaves(
    vectors: DataFrame,
    tops: DataFrame,
    leaves: DataFrame,
    depth: int,
    beam: int = BEAM,
    id_col: str = "doc_id",
    vec_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, cell, score, rank)``: the ``depth`` best centroids among those of the ``beam`` best groups.

    Vectors and centroids of a group meet in blocks, so neither a large group nor many centroids
    are held by one task. Ids are unique.
    """
    asked = route_queries(vectors.select(id_col, vec_col), tops, [beam], vec_col).drop("setting")
    schema = T.StructType(
        [
            vectors.schema[id_col],
            T.StructField("leaf", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    found = search_in_blocks(
        leaves, asked, schema, depth, "leaf", "centroid", [id_col], vec_col, block_bytes
    )
    return rank_top_k(found, depth, [id_col], "leaf").withColumnRenamed("leaf", "cell")


def assign_tree_cells(
    vectors: DataFrame,
    tops: DataFrame,
    leaves: DataFrame,
    beam: int = BEAM,
    id_col: str = "doc_id",
    vec_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds ``cell`` as ``assign_cells`` does, looking at the ``beam`` best groups of ``cell_tree``."""
    nearest = nearest_leaves(vectors, tops, leaves, 1, beam, id_col, vec_col, block_bytes)
    return vectors.join(nearest.select(id_col, "cell"), id_col)


def search_cell_tree(
    assigned: DataFrame,
    queries: DataFrame,
    tops: DataFrame,
    leaves: DataFrame,
    probes: list[int],
    k: int = 20,
    beam: int = BEAM,
    doc_col: str = "doc_id",
    vec_col: str = "embedding",
    query_col: str = "query_id",
    query_vec: str = "qvec",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``search_cells`` with the centroids of ``cell_tree``: a query visits the best cells among those
    of its ``beam`` best groups. The visits are a staged table; of saved cells only those are read.
    """
    probes = sorted(set(probes))
    if not probes or probes[0] <= 0:
        raise ValueError("nprobe must be positive")
    visits = nearest_leaves(
        queries, tops, leaves, probes[-1], beam, query_col, query_vec, block_bytes
    )
    # The predicate holds for every row; partition pruning at run time asks for one.
    visits = stage(visits.select(query_col, "cell", "rank"), "visits").filter(F.col("rank") > 0)
    schema = T.StructType(
        [
            queries.schema[query_col],
            T.StructField("setting", T.IntegerType()),
            assigned.schema[doc_col],
            T.StructField("score", T.DoubleType()),
        ]
    )
    fetched = _small_queries(queries, query_col, query_vec, probes, broadcast_bytes)
    if fetched is None:
        settings = F.array(*[F.lit(int(x)) for x in _first_settings(probes)])
        routed = queries.select(query_col, query_vec).join(visits, query_col)
        routed = routed.withColumn("setting", F.get(settings, F.col("rank") - 1)).drop("rank")
        scored = search_in_blocks(
            assigned.join(visits.select("cell").distinct(), "cell", "left_semi"), routed, schema, k,
            doc_col, vec_col, [query_col, "setting"], query_vec, block_bytes,
        )
    else:
        keys, matrix = fetched
        made = visits.toArrow()  # at most ``broadcast_bytes``
        rows = pc.index_in(made[query_col], keys[query_col].combine_chunks()).to_numpy()
        cells, places = made["cell"].to_numpy(), made["rank"].to_numpy() - 1
        scored = _scored_visits(
            assigned, keys, matrix, cells, rows, places, probes, schema, k, doc_col, vec_col
        )
    return _ranked_settings(scored, probes, k, query_col, doc_col)


def write_cells(assigned: DataFrame, location: str) -> None:
    """One folder per cell; a large cell becomes several files, small ones one."""
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(location)


def read_cells(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(location).withColumn("cell", F.col("cell").cast("long"))


CODES_PER_TABLE = 2**20
CODE_DIGITS = 6  # of a projection, before it is cut into buckets


def _projection_codes(rows: np.ndarray, axes: np.ndarray, width: float) -> np.ndarray:
    """Bucket of every row on every axis, numbered apart for each axis."""
    buckets = np.floor((np.round(rows @ axes.T, CODE_DIGITS) + 0.0) / width).astype("int64")
    return buckets + CODES_PER_TABLE // 2 + np.arange(len(axes)) * CODES_PER_TABLE


def assign_projection_buckets(
    vectors: DataFrame, axes: DataFrame, width: float, vec_col: str = "embedding"
) -> DataFrame:
    """Bucketed random projection: one row and ``cell`` per vector and axis.

    ``axes(cell, centroid)`` are the directions, one hash table each. For unit
    vectors start with a ``width`` near ``1 / sqrt(dimension)``.
    """
    if width <= 2 / CODES_PER_TABLE:
        raise ValueError("width is too small")
    _, directions = small_matrix(axes, ["cell"], "centroid")
    shared = vectors.sparkSession.sparkContext.broadcast(directions)
    position = vectors.columns.index(vec_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _projection_codes(to_matrix(batch.column(position)), shared.value, width)
                yield batch.append_column(
                    "_cells", pa.array(codes.tolist(), pa.list_(pa.int64()))
                )

    schema = T.StructType(
        [*vectors.schema.fields, T.StructField("_cells", T.ArrayType(T.LongType()))]
    )
    return vectors.mapInArrow(assign, schema).withColumn("cell", F.explode("_cells")).drop("_cells")


def search_projection_buckets(
    assigned: DataFrame,
    queries: DataFrame,
    axes: DataFrame,
    width: float,
    k: int = 20,
    doc_col: str = "doc_id",
    vec_col: str = "embedding",
    query_col: str = "query_id",
    query_vec: str = "qvec",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact scores of the vectors that share a bucket with the query on any axis.

    A vector comes up at most once per axis, so the ``k * axes`` best rows hold the k
    best vectors.
    """
    _, directions = small_matrix(axes, ["cell"], "centroid")
    schema = T.StructType(
        [
            queries.schema[query_col],
            assigned.schema[doc_col],
            T.StructField("score", T.DoubleType()),
        ]
    )
    depth = k * len(directions)
    fetched = matrix_within(queries, [query_col], query_vec, broadcast_bytes)
    if fetched is None:
        asked = assign_projection_buckets(
            queries.select(query_col, query_vec), axes, width, query_vec
        )
        found = search_in_blocks(
            assigned, asked, schema, depth, doc_col, vec_col, [query_col], query_vec, block_bytes
        )
    else:
        keys, matrix = fetched
        codes = _projection_codes(matrix, directions, width)
        rows = np.repeat(np.arange(len(matrix)), codes.shape[1])
        routes = Routes.of(codes.ravel(), rows, rows)
        visited = queries.sparkSession.createDataFrame(pa.table({"cell": routes.cells}))
        found = search_with_broadcast(
            assigned.join(stage(visited.coalesce(1), "visited_buckets"), "cell", "left_semi"),
            keys, matrix, schema, depth, doc_col, vec_col, routes,
        )
    once = found.groupBy(query_col, doc_col).agg(F.max("score").alias("score"))
    return rank_top_k(once, k, [query_col], doc_col)


def recall_against_exact(
    exact: DataFrame,
    approximate: DataFrame,
    k: int = 10,
    setting_cols: list[str] = ("nprobe",),
    doc_col: str = "doc_id",
    query_col: str = "query_id",
) -> DataFrame:
    """Mean share of the exact top k that the approximate top k holds.

    The denominator is always k; a query without overlap counts as 0.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    settings = list(setting_cols)
    truth = exact.filter(F.col("rank") <= k).select(query_col, doc_col)
    found = approximate.filter(F.col("rank") <= k).select(*settings, query_col, doc_col)
    overlap = found.join(truth, [query_col, doc_col])
    hits = overlap.groupBy(*settings).agg(F.count("*").alias("hits"))
    asked = exact.agg(F.count_distinct(query_col)).scalar()
    return (
        approximate.select(*settings)
        .distinct()
        .join(hits, settings, "left")
        .select(
            *settings,
            (F.coalesce("hits", F.lit(0)) / (asked * F.lit(k))).alias(f"ann_recall_at_{k}"),
        )
    )
