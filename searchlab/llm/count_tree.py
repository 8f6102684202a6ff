"""N-gram Jaccard join by count vectors and R-trees.

1. Every whole text becomes its set of word shingles (64-bit). The shingles are hashed into
   groups; how many fall into each group is the set's point. What two sets have in common
   is at most the sum of the smaller coordinates of their points.
2. The forest: sets whose similarity reaches the threshold differ in at most D shingles, so
   of D + 1 parts of the groups at least one has equal counts in both. The root of the
   index therefore sends each set once for every part to the bucket of its counts there. D depends on
   the size; sets are indexed by classes of size, and in the next class too where partners can
   lie there. This is exact: every pair at the threshold meets in a bucket.
3. A bucket is one R-tree over the points of its sets (a large one is cut into pages, and
   each pair of pages is joined). A node holds the largest coordinates and the least and largest
   size below it. Pairs of nodes whose bound stays below the threshold are left out.
4. Pairs that survive are decided on their full sets. Links found tie sets together, and nodes or
   pairs of one component are not compared again: the first round takes the nearest set of each
   set of a bucket, the second its ``NEAREST`` nearest ones, the last one every pair that is left.

Equal sets are one set from the start; copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from searchlab.llm.common import document_columns
from searchlab.llm.components import components
from searchlab.llm.minhash import shingle_set
from searchlab.sources.staging import stage

PERCENT = 90
GROUPS = 128
CLASS_RATIO = 1.25
LEAF = 16
PAGE = 1024
NEAREST = (1, 8, None)


def most_difference(total: int, percent: int) -> int:
    """Most shingles in one of two sets only, at ``100 * intersection >= percent * union``."""
    return total * (100 - percent) // (100 + percent)


@cache
def class_start(number: int) -> int:
    """Least size of a class of sizes."""
    return 1 if number == 0 else max(class_start(number - 1) + 1, int(class_start(number - 1) * CLASS_RATIO))


@cache
def _class_parts(number: int, percent: int) -> tuple[int, int]:
    """(least size indexed, parts) of a class; no parts where only equal sets reach the threshold."""
    difference = most_difference(2 * (class_start(number + 1) - 1), percent)
    return -(-percent * class_start(number) // 100), difference + 1 if difference else 0


@cache
def _part_ends(parts: int) -> np.ndarray:
    return np.array([i * 2**64 // parts for i in range(1, parts)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _first_class(n: int) -> int:
    number = 0
    while class_start(number + 1) <= n:
        number += 1
    return number


def bucket_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the buckets that a set (sorted hashes) goes to.

    The high bits of a hash choose the part, the low 16 bits the group inside of it: the sum of one random
    number for each shingle stands for the counts of the groups.
    """
    n = len(members)
    if not n:
        return np.empty(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(members & np.uint64(0xFFFF)))])
    number, keys = _first_class(n), []
    while True:
        least, parts = _class_parts(number, percent)
        if n < least:
            break
        if parts:
            ends = np.searchsorted(members, _part_ends(parts))
            upto = sums[np.concatenate([ends, [n]])]
            counts = upto - np.concatenate([sums[:1], upto[:-1]])
            keys.append(_mixed(counts ^ _mixed(np.arange(parts, dtype=np.uint64) + np.uint64(number << 40))))
        number += 1
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def point(members: np.ndarray) -> np.ndarray:
    """How many shingles fall into each group."""
    return np.bincount((members >> np.uint64(20)) & np.uint64(GROUPS - 1), minlength=GROUPS)


def packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == GROUPS else "<u4").astype(np.int32)


def _features(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, set_key (16 bytes of the whole set), keys, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, names, keys, counts = [], [], [], []
            for text in batch.column(1):
                members = shingle_set(text.as_py(), words)
                sizes.append(len(members))
                names.append(xxhash.xxh3_128_digest(members.tobytes()))
                keys.append(bucket_keys(members, percent))
                counts.append(packed(point(members)))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary())]
            arrays += [pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "set_key", "keys", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, set_key binary, keys array<long>, counts binary")


class Tree:
    """R-tree over points, halved along the widest coordinate down to leaves of ``LEAF``.

    Node i has its rows in ``order[start[i] : end[i]]``; its halves are ``below[i]`` (-1: a leaf).
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.points, self.sizes, self.comps = points, sizes, comps
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int]] = []
        self.most: list[np.ndarray] = []
        self.ranges: list[tuple[int, int]] = []
        self.comp: list[int | None] = []
        self._grow(0, len(points))

    def _grow(self, start: int, end: int) -> int:
        rows = self.order[start:end]
        number = len(self.nodes)
        own = self.points[rows]
        self.most.append(own.max(axis=0))
        self.ranges.append((int(self.sizes[rows].min()), int(self.sizes[rows].max())))
        self.comp.append(int(self.comps[rows[0]]) if (self.comps[rows] == self.comps[rows[0]]).all() else None)
        self.nodes.append((start, end, -1))
        if end - start > LEAF:
            widest = int(np.argmax(self.most[number] - own.min(axis=0)))
            self.order[start:end] = rows[np.argsort(own[:, widest], kind="stable")]
            middle = (start + end) // 2
            self._grow(start, middle)
            self.nodes[number] = (start, end, self._grow(middle, end))
        return number

    def halves(self, node: int) -> tuple[int, int]:
        return node + 1, self.nodes[node][2]

    def rows(self, node: int) -> np.ndarray:
        return self.order[slice(*self.nodes[node][:2])]


def _reach(most, one, two, percent: int):
    """Whether ``most`` in common is enough for sets of at least these sizes."""
    return 100 * most >= percent * (one + two - most)


def tree_pairs(one: Tree, two: Tree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of one, row of two, most in common) of all pairs of different components that the
    bound cannot exclude; of a tree with itself each pair once."""
    same = one is two
    waiting, found = [(0, 0)], []
    while waiting:
        i, j = waiting.pop()
        if one.comp[i] is not None and one.comp[i] == two.comp[j]:
            continue
        (least_i, most_i), (least_j, most_j) = one.ranges[i], two.ranges[j]
        bound = min(int(np.minimum(one.most[i], two.most[j]).sum()), most_i, most_j)
        if not _reach(bound, least_i, least_j, percent):
            continue
        (start_i, end_i, down_i), (start_j, end_j, down_j) = one.nodes[i], two.nodes[j]
        if same and i == j and down_i >= 0:
            left, right = one.halves(i)
            waiting += [(left, left), (left, right), (right, right)]
        elif down_i >= 0 and (down_j < 0 or end_i - start_i >= end_j - start_j):
            waiting += [(half, j) for half in one.halves(i)]
        elif down_j >= 0:
            waiting += [(i, half) for half in two.halves(j)]
        else:
            a, b = one.rows(i), two.rows(j)
            common = np.minimum(one.points[a][:, None], two.points[b][None]).sum(axis=2)
            good = _reach(common, one.sizes[a][:, None], two.sizes[b][None], percent)
            good &= one.comps[a][:, None] != two.comps[b][None]
            if same and i == j:
                good &= np.arange(len(a))[:, None] < np.arange(len(b))[None]
            x, y = np.nonzero(good)
            if len(x):
                found.append((a[x], b[y], common[x, y]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _nearest(a: np.ndarray, b: np.ndarray, likeness: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that are among the k most alike ones of either side's row."""
    keep = np.zeros(len(a), bool)
    for side, other in ((a, b), (b, a)):
        order = np.lexsort((other, -likeness, side))
        ordered = side[order]
        keep[order[np.arange(len(side)) - np.searchsorted(ordered, ordered) < k]] = True
    return np.flatnonzero(keep)


def _cell_pairs(cell: dict[str, np.ndarray], percent: int, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of one cell: a bucket or two pages of a large one."""
    node, sizes, comps = cell["node"], cell["n"], cell["comp"]
    points = np.stack([unpacked(x) for x in cell["counts"]])
    first = cell["page"] == cell["low"]
    if cell["low"][0] == cell["high"][0]:
        sides = (np.arange(len(node)),) * 2
        tree = Tree(points, sizes, comps)
        a, b, common = tree_pairs(tree, tree, percent)
    else:
        sides = np.flatnonzero(first), np.flatnonzero(~first)
        if not len(sides[0]) or not len(sides[1]):
            return (np.empty(0, np.int64),) * 2
        one, two = (Tree(points[s], sizes[s], comps[s]) for s in sides)
        a, b, common = tree_pairs(one, two, percent)
    a, b = sides[0][a], sides[1][b]
    if nearest is not None and len(a):
        kept = _nearest(a, b, common / (sizes[a] + sizes[b] - common), nearest)
        a, b = a[kept], b[kept]
    return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])


def _cells(members: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Pairs (a, b) of all cells of ``members`` (key, node, comp, n, counts, size)."""
    pages = F.ceil(F.col("size") / PAGE).cast("int")
    paged = members.withColumn("pages", pages).withColumn("page", F.pmod(F.xxhash64("node"), F.col("pages")).cast("int"))
    spread = paged.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).select(
        "key", F.least("page", "other").alias("low"), F.greatest("page", "other").alias("high"),
        "page", "node", "comp", "n", "counts",
    )
    names = ["key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest, cells = _complete(table if rest is None else pa.concat_tables([rest, table]), names)
            yield from _joined(cells, percent, nearest)
        if rest is not None:
            yield from _joined(_split(rest, names), percent, nearest)

    return spread.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long").distinct()


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    changes = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in names:
        values = table.column(name).to_numpy()
        changes |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(changes) + 1]) if table.num_rows else np.empty(0, np.int64)


def _split(table: pa.Table, names: list[str]) -> list[pa.Table]:
    starts = _starts(table, names)
    return [table.slice(s, e - s) for s, e in zip(starts, [*starts[1:], table.num_rows])]


def _complete(table: pa.Table, names: list[str]) -> tuple[pa.Table | None, list[pa.Table]]:
    """The last cell, which may go on, and the ones before it."""
    cells = _split(table, names)
    return (cells[-1], cells[:-1]) if cells else (None, [])


def _joined(cells: list[pa.Table], percent: int, nearest: int | None) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for table in cells:
        if table.num_rows > 1:
            cell = {name: table.column(name).to_numpy() for name in ("low", "high", "page", "node", "comp", "n")}
            cell["counts"] = table.column("counts").to_pylist()
            one, two = _cell_pairs(cell, percent, nearest)
            a.append(one)
            b.append(two)
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(x.as_py(), np.uint64) for x in (one, two))
                keep.append(_reach(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, sets: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(node, members): whole sets of the nodes that share a bucket.

    The text of a set is read from a document that has its smallest id; where that id repeats
    with other texts, their sets are made too and fall out by their key.
    """
    needed = sets.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "set_key", "least")
    needed = stage(needed, "needed_sets")
    texts = docs.join(needed.hint("merge"), docs["doc_id"].eqNullSafe(needed["least"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)]
            keys = [xxhash.xxh3_128_digest(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["set_key", "members"])

    made = texts.mapInArrow(run, "set_key binary, members binary")
    return made.join(needed.select("node", "set_key").hint("merge"), "set_key").select("node", "members").dropDuplicates(["node"])


def _bucket_members(sets: DataFrame) -> DataFrame:
    """(key, node, n, counts, size) of buckets with two or more sets."""
    entries = sets.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    found = entries.join(shared.hint("merge"), "key")
    return found.join(sets.select("node", "n", "counts").hint("merge"), "node")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their component so far, only of buckets that hold more than one."""
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    known = labels.select(F.col("node").alias("known"), "component")
    named = members.join(known, F.col("node") == F.col("known"), "left").select(
        *members.columns, F.coalesce("component", "node").alias("comp")
    )
    named = stage(named, "labelled")
    mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
    return named.join(mixed.select("key").hint("merge"), "key", "left_semi")


def _same_id_links(features: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links between the different sets of rows with one id."""
    rows = features.filter("n > 0 and doc_id is not null").select("doc_id", "set_key")
    several = rows.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low != high")
    several = stage(several.select("doc_id", "low"), "repeated_ids")
    if several.isEmpty():
        return None
    nodes = sets.select("set_key", "node")
    return (
        rows.join(several, "doc_id").join(nodes.withColumnRenamed("node", "a"), "set_key")
        .join(nodes.select(F.col("set_key").alias("low"), F.col("node").alias("b")), "low").select("a", "b").distinct()
    )


def jaccard_components(
    docs: DataFrame,
    words: int = 3,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    Words are separated by white space (space, 09 to 0D), A-Z are lower-cased; the set of a
    document is its distinct shingles of ``words`` words, the whole sequence where it has
    fewer words. Documents with ``100 * intersection >= percent * union`` are linked (``percent``
    from 1 to 100); ``component_id`` is the smallest id reached.
    Texts that are null, empty or white space have no shingles and are linked with
    nothing. Rows that repeat an id are one document for the links, whatever their texts. A row
    with a null id gets its component's id, null where no member has one. Other columns
    are ignored; an empty table gives no rows.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    source = document_columns(docs, id_col, text_col)
    features = stage(_features(source, words, percent), "counted_shingles")
    sets = features.filter("n > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "keys", "counts"))
    )
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "distinct_sets")
    members = stage(_bucket_members(sets), "bucket_members")
    full = stage(_full_sets(source, sets, members, words), "full_sets")

    tied = _same_id_links(features, sets)
    links = [] if tied is None else [stage(tied, "same_id")]
    labels = components(links[0]) if links else None
    if labels is not None:
        labels = stage(labels, "components")
    for nearest in NEAREST:
        pairs = _cells(_labelled(members, labels), percent, nearest)
        links.append(stage(_verified(pairs, full, percent), "verified"))
        labels = stage(components(reduce(DataFrame.unionByName, links)), "components")

    named = sets.select("set_key", "least", "node").join(
        labels.select(F.col("node").alias("known"), "component"), F.col("node") == F.col("known"), "left"
    ).select("set_key", "least", F.coalesce("component", "node").alias("component"))
    named = stage(named, "named_sets")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(smallest.hint("merge"), "component").select(F.col("set_key").alias("found_key"), "component_id")
    rows = features.select("doc_id", "n", "set_key").join(found.hint("merge"), F.col("set_key") == F.col("found_key"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
