"""Hard negatives: Strassen products of integer tiles, mergeable heaps.

Vectors become whole numbers, ``floor(scale * x)``. Anchors and candidates are cut into
blocks; every pair of blocks is one group of the grid, so neither side is ever whole in one
place. A group multiplies tiles by Strassen's recursion in 64-bit integers and keeps, for each
anchor, a heap of its best rows; heaps of groups merge by one more cut. The first pass
keeps the best rows of the anchor's own label, its positives. The second one multiplies again and keeps one
heap for each positive: the best rows of other labels whose score lies in the window that
the positive's score opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from searchlab.sources.staging import stage

SCALE = 256
LEAF = 8  # no dimension of a product that is still cut is as small as this
TILE = (512, 4096)  # anchors and candidates of one product
ANCHOR_BLOCK = 4096
CANDIDATE_BLOCK = (4096, 65536)  # smallest and largest
NOTHING = np.iinfo(np.int64).min


def _evened(matrix: np.ndarray) -> np.ndarray:
    rows, columns = matrix.shape
    if rows % 2 or columns % 2:
        matrix = np.pad(matrix, ((0, rows % 2), (0, columns % 2)))
    return matrix


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product in 64-bit integers, by seven products of halves.

    Odd sides get a line of zeros. Sums of the recursion may pass 64 bits: they wrap, and
    the result is exact wherever it fits itself.
    """
    rows, inner, columns = *a.shape, b.shape[1]
    if min(rows, inner, columns) <= LEAF:
        return a @ b
    a, b = _evened(a), _evened(b)
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    out = np.empty((2 * r, 2 * c), np.int64)
    c11, c12, c21, c22 = out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:]
    product = strassen(a11 + a22, b11 + b22)
    c11[:], c22[:] = product, product
    product = strassen(a21 + a22, b11)
    c21[:] = product
    c22 -= product
    product = strassen(a11, b12 - b22)
    c12[:] = product
    c22 += product
    product = strassen(a22, b21 - b11)
    c11 += product
    c21 += product
    product = strassen(a11 + a12, b22)
    c11 -= product
    c12 += product
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return out[:rows, :columns]


def best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of every row, of equal ones the first.

    ``NOTHING`` is no value.
    """
    width = scores.shape[1]
    k = min(k, width)
    limit = np.partition(scores, width - k, axis=1)[:, width - k, None]
    above = scores > limit
    equal = (scores == limit) & (limit > NOTHING)
    equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | equal)


class Heaps:
    """The best k (score, id) of each of n owners; higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.owner = self.score = self.id = np.empty(0, np.int64)

    def merge(self, owner: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        owner = np.concatenate([self.owner, owner])
        score = np.concatenate([self.score, score])
        id_ = np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order, owner = order[place < self.k], owner[place < self.k]
        self.owner, self.score, self.id = owner, score[order], id_[order]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    at = 0
    for chunk in column.chunks:
        lengths = np.diff(chunk.offsets.to_numpy())
        values = chunk.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[at + rows, places] = values
        at += len(lengths)
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _require_range(a: np.ndarray, b: np.ndarray) -> None:
    most = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) for m in (a, b)]
    if most[0] * most[1] >= 2.0**62:
        raise ValueError("scores of these vectors do not fit 64-bit integers: scale them down")


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first anchor, first candidate, scores) of all tiles of a x b'."""
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(b), TILE[1]):
            yield i, j, strassen(a[i : i + TILE[0]], b[j : j + TILE[1]].T)


def _in_order(candidates: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = _numbers(candidates, "vec_id"), _numbers(candidates, "label")
    order = np.argsort(ids, kind="stable")
    return ids[order], labels[order], _matrix(candidates.column("vector"), width)[order]


def _positives(anchors: pa.Table, candidates: pa.Table, width: int, k: int) -> pa.Table:
    heaps = Heaps(k)
    if len(anchors) and len(candidates):
        a, a_ids, a_labels = _matrix(anchors.column("vector"), width), _numbers(anchors, "vec_id"), _numbers(anchors, "label")
        ids, labels, b = _in_order(candidates, width)
        _require_range(a, b)
        for label in np.intersect1d(a_labels, labels):
            own, same = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
            for i, j, scores in _tiles(a[own], b[same]):
                rows, columns = own[i : i + len(scores)], same[j : j + scores.shape[1]]
                scores[a_ids[rows, None] == ids[columns]] = NOTHING
                r, c = best_places(scores, k)
                heaps.merge(a_ids[rows[r]], scores[r, c], ids[columns[c]])
    return pa.table({"anchor_id": heaps.owner, "id": heaps.id, "score": heaps.score})


def window_ends(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole s with low * score <= 100 * s <= high * score."""
    hundreds, rest = np.divmod(score, 100)
    return hundreds * low - (-rest * low) // 100, hundreds * high + rest * high // 100


def _negatives(anchors: pa.Table, candidates: pa.Table, width: int, k: int, low: int, high: int) -> pa.Table:
    """Owners are numbered anchor by anchor, one for each positive."""
    heaps = Heaps(k)
    places = anchors.column("places").combine_chunks() if len(anchors) else None
    if places is not None and len(candidates):
        a, a_ids, a_labels = _matrix(anchors.column("vector"), width), _numbers(anchors, "vec_id"), _numbers(anchors, "label")
        starts, wanted = places.offsets.to_numpy(), places.flatten().field("score").to_numpy()
        least, most = window_ends(wanted, low, high)
        deep = int(np.diff(starts).max(initial=0))
        ids, labels, b = _in_order(candidates, width)
        _require_range(a, b)
        for i, j, scores in _tiles(a, b):
            rows, columns = np.arange(i, i + len(scores)), slice(j, j + scores.shape[1])
            other = (a_labels[rows, None] != labels[columns]) & (a_ids[rows, None] != ids[columns])
            for turn in range(deep):
                owner = starts[rows] + turn
                has = owner < starts[rows + 1]
                owner = owner[has]
                part = scores[has]
                fits = other[has] & (part >= least[owner, None]) & (part <= most[owner, None])
                some = fits.any(axis=1)
                r, c = best_places(np.where(fits[some], part[some], NOTHING), k) if some.any() else ([], [])
                if len(r):
                    heaps.merge(owner[some][r], part[some][r, c], ids[columns][c])
    owner = heaps.owner
    if not len(owner):
        return pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "positive", "negative_id", "negative_score")})
    anchor = np.searchsorted(starts, owner, side="right") - 1
    return pa.table({
        "anchor_id": a_ids[anchor], "positive": owner - starts[anchor],
        "negative_id": heaps.id, "negative_score": heaps.score,
    })


def whole_numbers(
    vectors: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int
) -> DataFrame:
    """(vec_id, label, vector, anchor) of the rows that take part."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # not a number is above
    rows = rows.filter("vec_id is not null and label is not null and vector is not null").filter(finite)
    far = F.exists("vector", lambda x: F.abs(x) >= 2.0**50)
    return rows.withColumn(
        "vector",
        F.when(far, F.raise_error(F.lit("vector components of 2^50 or more: scale them down")).cast("array<long>"))
        .otherwise(F.transform("vector", lambda x: F.floor(x * scale).cast("long"))),
    )


def _best(rows: DataFrame, owner: list[str], score: str, id_: str, k: int, name: str) -> DataFrame:
    """Merges the heaps of all groups: the first k rows of each owner, numbered."""
    order = Window.partitionBy(*owner).orderBy(F.col(score).desc(), id_)
    return rows.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as ``floor(scale * x)``, a score is the inner product; higher
    scores come first, ties by smaller id. Positives of an anchor (a row where ``is_anchor``
    holds) are its first ``positives`` rows of the same label; for each of them its first
    ``negatives`` rows of another label with ``low * positive_score <= 100 * score <= high *
    positive_score`` follow (all where there are fewer; ``rank`` counts from 1).

    Rows with a null id or label, a null vector or a null or non-finite component take no part.
    Vectors of different lengths are filled with zeros, an empty one scores 0. Rows that have an
    anchor's own id are never its positives or negatives; of several anchors with one id
    the least (label, vector) is taken; other repeated rows count each. Scores that might
    not fit 64 bits raise an error. Other columns are ignored; no anchors or
    no positives give no rows.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, is_anchor, id_col, label_col, vector_col, scale)
    n = vectors.count()
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(-(-n // CANDIDATE_BLOCK[1]), min(tasks, -(-n // CANDIDATE_BLOCK[0])), 1)
    # Written with its group, so that a repeated task finds the same one.
    rows = rows.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
    rows = stage(rows, "whole_vectors")
    anchors = rows.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    anchors = stage(anchors.select("vec_id", "row.label", "row.vector"), "anchors")
    n_anchors = anchors.count()
    width = int(rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0])
    blocks = max(-(-n_anchors // ANCHOR_BLOCK), 1)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    candidates = rows.select(
        "vec_id", "label", "vector", "g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    ).groupBy("b", "g")

    def grid(side: DataFrame, run, schema: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b")
        return side.select("*", block, everywhere).groupBy("b", "g").cogroup(candidates).applyInArrow(run, schema)

    found = grid(
        anchors, lambda left, right: _positives(left, right, width, positives), "anchor_id long, id long, score long"
    )
    found = stage(_best(found, ["anchor_id"], "score", "id", positives, "place"), "positives")
    opened = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("places")
    )
    opened = stage(anchors.join(opened, "vec_id"), "opened_anchors")
    mined = grid(
        opened, lambda left, right: _negatives(left, right, width, negatives, low, high),
        "anchor_id long, positive long, negative_id long, negative_score long",
    )
    mined = _best(mined, ["anchor_id", "positive"], "negative_score", "negative_id", negatives, "rank")
    known = found.select(
        "anchor_id", (F.col("place") - 1).cast("long").alias("positive"),
        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return mined.join(known, ["anchor_id", "positive"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
