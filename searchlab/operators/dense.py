"""Exact inner-product search, as blocked matrix products with a running top-k.

Vectors stay where Spark put them: each task multiplies its Arrow batches with the
query matrix and keeps k rows per query, and only these rows are shuffled. A query
matrix above ``BROADCAST_BYTES`` is not sent to every task; both sides are then cut
into blocks of bounded size and every pair of blocks is multiplied in a task of
its own, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from searchlab.operators.topk import rank_top_k
from searchlab.sources.staging import stage

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
PRODUCT_NUMBERS = 8 * 1024 * 1024  # scores a task holds at a time
DROPPED_BITS = 12  # of the 52 binary digits of a double


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column -> float64 matrix; every row must have the same width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vector column holds nulls")
    widths = set(pc.value_counts(pc.list_value_length(column)).field(0).to_pylist())
    if len(widths) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(widths)}")
    width = widths.pop() if widths else 0
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width).astype(np.float64, copy=False)


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products to 40 binary digits (12 decimal ones).

    The last bits of a matrix product depend on the place of a row in its block;
    without them equal vectors score alike wherever they are.
    """
    bits = np.ascontiguousarray(left @ right.T).view(np.int64)
    bits += 1 << (DROPPED_BITS - 1)
    bits &= -(1 << DROPPED_BITS)
    return bits.view(np.float64) + 0.0


def best_rows(rows: np.ndarray, among: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``among`` of the ``depth`` best products of each row, ties to the first, and the products.

    At most ``PRODUCT_NUMBERS`` products exist at a time; only the best are sorted.
    """
    depth = min(depth, len(among))
    best = np.empty((len(rows), depth), dtype=np.int64)
    products = np.empty((len(rows), depth))
    step = max(1, PRODUCT_NUMBERS // max(len(among), 1))
    for start in range(0, len(rows), step):
        some = slice(start, start + step)
        scores = inner_products(rows[some], among)
        if depth == 1:
            best[some, 0] = scores.argmax(axis=1)
        else:
            last = len(among) - depth
            limit = np.partition(scores, last, axis=1)[:, last, None]
            above, equal = scores > limit, scores == limit
            equal &= np.cumsum(equal, axis=1) <= depth - above.sum(axis=1, keepdims=True)
            found = np.nonzero(above | equal)[1].reshape(-1, depth)
            order = np.argsort(-np.take_along_axis(scores, found, axis=1), axis=1, kind="stable")
            best[some] = np.take_along_axis(found, order, axis=1)
        products[some] = np.take_along_axis(scores, best[some], axis=1)
    return best, products


class RunningTopK:
    """Best k (score, id) per query, higher score first, then lower id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * queries
        self.ids: list[np.ndarray | None] = [None] * queries

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.scores[query]
        if len(held) == self.k:
            chance = scores >= held[-1]
            scores, ids = scores[chance], ids[chance]
        if not len(scores):
            return
        if len(held):
            scores = np.concatenate([held, scores])
            ids = np.concatenate([self.ids[query], ids])
        if len(scores) > self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]

    def table(self, keys: pa.Table, doc_field: pa.Field) -> pa.Table:
        counts = [len(s) for s in self.scores]
        rows = keys.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        found = [i for i in self.ids if i is not None]
        ids = np.concatenate(found) if found else np.empty(0, dtype="int64")
        return rows.append_column(doc_field, pa.array(ids.tolist(), doc_field.type)).append_column(
            "score", pa.array(np.concatenate(self.scores or [np.empty(0)]), pa.float64())
        )


class Routes(NamedTuple):
    """Which rows of the query matrix visit a cell, and the list that each visit fills; by cell."""

    cells: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    lists: np.ndarray

    @classmethod
    def of(cls, cells: np.ndarray, rows: np.ndarray, lists: np.ndarray) -> "Routes":
        order = np.argsort(cells, kind="stable")
        found, starts = np.unique(cells[order], return_index=True)
        return cls(found, np.append(starts, len(cells)), rows[order], lists[order])

    def visitors(self, cell: int) -> tuple[np.ndarray, np.ndarray]:
        at = int(np.searchsorted(self.cells, cell))
        if at == len(self.cells) or self.cells[at] != cell:
            return self.rows[:0], self.lists[:0]
        part = slice(self.starts[at], self.starts[at + 1])
        return self.rows[part], self.lists[part]


def score_rows(
    best: RunningTopK, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, positions, lists=None
) -> None:
    """Offer ``rows`` to the queries at ``positions``, a bounded product at a time.

    ``lists`` names the list that each of them fills; its own where there is none.
    """
    lists = positions if lists is None else lists
    step = max(1, PRODUCT_NUMBERS // max(len(rows), 1))
    for start in range(0, len(positions), step):
        some = slice(start, start + step)
        for place, scores in zip(lists[some], inner_products(matrix[positions[some]], rows)):
            best.add(place, scores, ids)


def matrix_within(
    df: DataFrame, key_cols: list[str], vec_col: str, limit: int
) -> tuple[pa.Table, np.ndarray] | None:
    """Keys and matrix on the driver in key order; None above ``limit`` bytes."""
    rows, width = df.agg(F.count("*"), F.coalesce(F.max(F.size(vec_col)), F.lit(0))).first()
    if rows * width * 8 > limit:
        return None
    table = df.select(*key_cols, vec_col).toArrow().sort_by([(c, "ascending") for c in key_cols])
    return table.select(key_cols), to_matrix(table[vec_col])


def small_matrix(df: DataFrame, key_cols: list[str], vec_col: str) -> tuple[pa.Table, np.ndarray]:
    """The same for tables whose size is a parameter, such as centroids."""
    found = matrix_within(df, key_cols, vec_col, BROADCAST_BYTES)
    if found is None:
        raise ValueError(f"{vec_col}: more than {BROADCAST_BYTES} bytes for every task")
    return found


def _result_schema(queries: DataFrame, query_cols: list[str], doc: T.StructField) -> T.StructType:
    fields = [queries.schema[c] for c in query_cols]
    return T.StructType([*fields, doc, T.StructField("score", T.DoubleType())])


def search_with_broadcast(
    vectors: DataFrame,
    keys: pa.Table,
    matrix: np.ndarray,
    schema: T.StructType,
    k: int,
    doc_col: str,
    vec_col: str,
    routes: Routes | None = None,
) -> DataFrame:
    """Local top-k of every task, a list for each row of ``keys``; with ``routes`` only in the cells
    that a query visits."""
    shared = vectors.sparkSession.sparkContext.broadcast((keys, matrix, routes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix, routes = shared.value
        best, doc_field = RunningTopK(keys.num_rows, k), None
        for batch in batches:
            doc_field = batch.schema.field(0)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = to_matrix(batch.column(1))
            if routes is None:
                score_rows(best, ids, rows, matrix, np.arange(len(matrix)))
                continue
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                visitors, lists = routes.visitors(int(cell))
                if len(visitors):
                    inside = cells == cell
                    score_rows(best, ids[inside], rows[inside], matrix, visitors, lists)
        if doc_field is not None:
            yield from best.table(keys, doc_field).to_batches()

    columns = [doc_col, vec_col] + ([] if routes is None else ["cell"])
    return vectors.select(*columns).mapInArrow(score, schema)


def search_in_blocks(
    vectors: DataFrame,
    queries: DataFrame,
    schema: T.StructType,
    k: int,
    doc_col: str,
    vec_col: str,
    query_cols: list[str],
    query_vec: str,
    block_bytes: int = BLOCK_BYTES,
    query_block_bytes: int | None = None,
) -> DataFrame:
    """Blocks of vectors meet blocks of queries, each pair in a task of its own.

    With a ``cell`` column on both sides only the blocks of one cell meet. A cell,
    or the whole table without cells, is cut by hash into as many blocks as its size
    asks for, so a cell that holds a large share of all rows becomes many tasks.
    """

    def number_of_blocks(df: DataFrame, vec: str, name: str, limit: int) -> DataFrame:
        grouped = df.groupBy(*[c for c in df.columns if c == "cell"])
        size = F.count("*") * F.coalesce(F.max(F.size(vec)), F.lit(0)) * 8
        blocks = F.greatest(F.ceil(size / F.lit(limit)), F.lit(1))
        return grouped.agg(blocks.cast("int").alias(name))

    per_side = (
        number_of_blocks(vectors, vec_col, "_v", block_bytes),
        number_of_blocks(queries, query_vec, "_q", query_block_bytes or block_bytes),
    )
    if "cell" in vectors.columns:
        # One row per cell, staged so that its size decides how it is joined.
        blocks = stage(per_side[0].join(per_side[1], "cell"), "cell_blocks")
        vectors, queries = vectors.join(blocks, "cell"), queries.join(blocks, "cell")
    else:
        v, q = (side.first()[0] for side in per_side)
        vectors, queries = (
            df.withColumns({"cell": F.lit(0), "_v": F.lit(v), "_q": F.lit(q)})
            for df in (vectors, queries)
        )

    def block_of(columns: list[str], count: str):
        return F.pmod(F.xxhash64(*columns), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = (
        vectors.withColumn("_vb", block_of([doc_col], "_v"))
        .withColumn("_qb", every("_q"))
        .select("cell", "_vb", "_qb", doc_col, vec_col)
    )
    right = (
        queries.withColumn("_qb", block_of(query_cols, "_q"))
        .withColumn("_vb", every("_v"))
        .select("cell", "_vb", "_qb", *query_cols, F.col(query_vec).alias("_query_vec"))
    )

    def multiply(docs: pa.Table, asked: pa.Table) -> pa.Table:
        keys = asked.select(query_cols)
        if not docs.num_rows or not asked.num_rows:
            docs, keys, scores = docs.slice(0, 0), keys.slice(0, 0), np.empty(0)
        else:
            docs = docs.sort_by(doc_col)  # equal scores go to the lower id
            rows, matrix = to_matrix(docs[vec_col]), to_matrix(asked["_query_vec"])
            places, scores = best_rows(matrix, rows, k)
            docs = docs.take(pa.array(places.ravel()))
            keys = keys.take(pa.array(np.repeat(np.arange(len(matrix)), places.shape[1])))
        found = keys.append_column(docs.schema.field(doc_col), docs[doc_col])
        return found.append_column("score", pa.array(scores.ravel(), pa.float64()))

    group = ["cell", "_vb", "_qb"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(multiply, schema)


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    doc_col: str = "doc_id",
    vec_col: str = "embedding",
    query_cols: list[str] = ("query_id",),
    query_vec: str = "qvec",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    query_block_bytes: int | None = None,
) -> DataFrame:
    """``(query columns, doc_col, score, rank)`` by inner product.

    A block of queries is as large as one of vectors unless ``query_block_bytes`` says otherwise.
    """
    query_cols = list(query_cols)
    schema = _result_schema(queries, query_cols, vectors.schema[doc_col])
    fetched = matrix_within(queries, query_cols, query_vec, broadcast_bytes)
    if fetched is not None:
        scored = search_with_broadcast(vectors, *fetched, schema, k, doc_col, vec_col)
    else:
        scored = search_in_blocks(
            vectors.select(doc_col, vec_col),
            queries.select(*query_cols, query_vec),
            schema, k, doc_col, vec_col, query_cols, query_vec, block_bytes, query_block_bytes,
        )
    return rank_top_k(scored, k, query_cols, doc_col)
