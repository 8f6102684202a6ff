"""Edit-aware token counts: a segment tree of counts for each document.

A text is cut into leaves of about ``LEAF`` characters, only before a space that is followed by something
else than white space: there the split pattern of the vocabulary always starts a new
pre-token, whatever stands before, so the counts of leaves add up to the count of the
text. An edit re-encodes the leaves it touches, and one more leaf to the left where it changes the
two characters that make the cut; every other leaf keeps its count, and only the sums on
the paths to the root change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from searchlab.llm.common import document_columns
from searchlab.llm.tokens import Encoder, default_tokenizer

LEAF = 256
_CUT = re.compile(r" (?=\S)")
EDITS = "array<struct<start: bigint, stop: bigint, replacement: string>>"


def leaves_of(text: str) -> list[str]:
    """The text in leaves of at least ``LEAF`` characters where it has cuts."""
    leaves, start = [], 0
    while True:
        cut = _CUT.search(text, start + LEAF)
        if cut is None:
            return [*leaves, text[start:]]
        leaves.append(text[start : cut.start()])
        start = cut.start()


class SumTree:
    """Sums over leaves: node i has the sum of nodes 2i and 2i + 1, node 1 the total."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes
        self.size = len(nodes) // 2

    @classmethod
    def of(cls, values: list[int]) -> "SumTree":
        size = 1 << max(0, len(values) - 1).bit_length()
        nodes = np.zeros(2 * size, "<i8")
        nodes[size : size + len(values)] = values
        while size > 1:
            nodes[size // 2 : size] = nodes[size : 2 * size : 2] + nodes[size + 1 : 2 * size : 2]
            size //= 2
        return cls(nodes)

    @property
    def total(self) -> int:
        return int(self.nodes[1])

    def set(self, leaf: int, value: int) -> None:
        node = leaf + self.size
        change = value - int(self.nodes[node])
        while node and change:
            self.nodes[node] += change
            node //= 2

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds a place; the last one for the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.nodes[node] and self.nodes[node + 1]:
                start += int(self.nodes[node])
                node += 1
        return node - self.size, start


def recount(
    leaves: list[str], counts: SumTree, edits: list[tuple[int, int, str]], encoder: Encoder,
    changed: list[tuple[int, int, str]] | None = None,
) -> tuple[int, int]:
    """Update ``counts`` for edits of the old text; (new total, characters re-encoded).

    ``changed`` takes the (first, last) leaves that were edited and their new text.
    """
    chars = SumTree.of([len(x) for x in leaves])
    regions: list[list] = []
    for start, stop, replacement in sorted(edits):
        first, at = chars.find(start)
        while first and start < at + 2:
            first -= 1
            at -= len(leaves[first])
        last, last_at = chars.find(max(start, stop - 1))
        # An edit up to a leaf's end leaves the cut behind it as it is.
        if regions and first <= regions[-1][1]:
            region = regions[-1]
            region[1] = max(region[1], last)
        else:
            region = [first, last, at, []]
            regions.append(region)
        region[3].append((start, stop, replacement))
    encoded = 0
    for first, last, at, own in regions:
        old = "".join(leaves[first : last + 1])
        parts, done = [], 0
        for start, stop, replacement in own:
            parts += [old[done : start - at], replacement]
            done = stop - at
        new = "".join([*parts, old[done:]])
        counts.set(first, len(encoder.ids(new)))
        for leaf in range(first + 1, last + 1):
            counts.set(leaf, 0)
        encoded += len(new)
        if changed is not None:
            changed.append((first, last, new))
    return counts.total, encoded


def spliced(
    leaves: list[str], counts: SumTree, edits: list[tuple[int, int, str]], encoder: Encoder
) -> tuple[list[str], SumTree]:
    """Leaves and tree of the text after edits; only the edited leaves are cut and encoded again."""
    values = counts.nodes[counts.size :].tolist()
    changed: list[tuple[int, int, str]] = []
    recount(leaves, SumTree(counts.nodes.copy()), edits, encoder, changed)
    new_leaves, new_values, done = [], [], 0
    for first, last, text in changed:
        own = leaves_of(text) if text else []
        new_leaves += [*leaves[done:first], *own]
        new_values += [*values[done:first], *(len(encoder.ids(x)) for x in own)]
        done = last + 1
    new_leaves += leaves[done:]
    new_values += values[done : len(leaves)]
    return new_leaves or [""], SumTree.of(new_values or [0])


def build_trees(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, leaves, counts (the tree's nodes as 64-bit numbers), n_tokens, n_chars.

    Null texts are empty and have no tokens; null ids stay, repeated rows are counted each,
    other columns are ignored, no rows give no rows.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                leaves = [leaves_of(t.as_py()) for t in batch.column(1)]
                trees = [SumTree.of([len(encoder.ids(x)) for x in own]) for own in leaves]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(leaves, pa.list_(pa.string())),
                        pa.array([t.nodes.tobytes() for t in trees], pa.binary()),
                        pa.array([t.total for t in trees], pa.int64()),
                        pa.array([sum(map(len, own)) for own in leaves], pa.int64()),
                    ],
                    ["doc_id", "leaves", "counts", "n_tokens", "n_chars"],
                )

    schema = f"doc_id {kind}, leaves array<string>, counts binary, n_tokens long, n_chars long"
    return document_columns(docs, id_col, text_col).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """Counts after edits: doc_id, n_tokens_before, n_tokens, n_chars, encoded_chars, n_edits.

    ``edits`` is a column of ``trees``: (start, stop, replacement) in code points of the old
    text, without overlaps, in any order; null or empty leaves the document as it is.
    ``n_chars`` is the length after the edits, ``encoded_chars`` counts what had to be encoded again.
    """
    path = tokenizer or default_tokenizer()
    kind = trees.schema["doc_id"].dataType.simpleString()
    source = trees.select("doc_id", "leaves", "counts", "n_tokens", "n_chars", edits.cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                after, encoded, number, chars_after = [], [], [], []
                for leaves, counts, n_chars, own in zip(*(batch.column(i) for i in (1, 2, 4, 5))):
                    own = [(e["start"], e["stop"], e["replacement"] or "") for e in own.as_py() or []]
                    tree = SumTree(np.frombuffer(counts.as_py(), "<i8").copy())
                    total, chars = recount(leaves.as_py(), tree, own, encoder)
                    after.append(total)
                    encoded.append(chars)
                    number.append(len(own))
                    n = n_chars.as_py()
                    gone = sum(max(min(stop, n) - min(start, n), 0) for start, stop, _ in own)
                    chars_after.append(n - gone + sum(len(new) for _, _, new in own))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(3), pa.array(after, pa.int64()), pa.array(chars_after, pa.int64()),
                        pa.array(encoded, pa.int64()), pa.array(number, pa.int32()),
                    ],
                    ["doc_id", "n_tokens_before", "n_tokens", "n_chars", "encoded_chars", "n_edits"],
                )

    return source.mapInArrow(
        run,
        f"doc_id {kind}, n_tokens_before long, n_tokens long, n_chars long, encoded_chars long, n_edits int",
    )


def edit_trees(trees: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """The trees after edits, with the columns of ``build_trees``, so that a next batch of edits can follow.

    ``edits`` are those of ``apply_edits``.
    """
    path = tokenizer or default_tokenizer()
    source = trees.select("doc_id", "leaves", "counts", edits.cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                rows = []
                for leaves, counts, own in zip(batch.column(1), batch.column(2), batch.column(3)):
                    own = [(e["start"], e["stop"], e["replacement"] or "") for e in own.as_py() or []]
                    rows.append(spliced(leaves.as_py(), SumTree(np.frombuffer(counts.as_py(), "<i8")), own, encoder))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([x for x, _ in rows], pa.list_(pa.string())),
                        pa.array([t.nodes.tobytes() for _, t in rows], pa.binary()),
                        pa.array([t.total for _, t in rows], pa.int64()),
                        pa.array([sum(map(len, x)) for x, _ in rows], pa.int64()),
                    ],
                    ["doc_id", "leaves", "counts", "n_tokens", "n_chars"],
                )

    kind = trees.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaves array<string>, counts binary, n_tokens long, n_chars long"
    return source.mapInArrow(run, schema)


def revision(slots: int = 3, longest: int = 24) -> Column:
    """Edits derived from id and length: one in each of ``slots`` equal parts of the text.

    Each replaces up to ``longest`` characters by a word, a number, a line break or nothing.
    """

    def edit(slot: Column) -> Column:
        low = F.floor(F.col("n_chars") * slot / slots)
        high = F.floor(F.col("n_chars") * (slot + 1) / slots)
        start = low + F.pmod(F.xxhash64("doc_id", slot), F.greatest(high - low, F.lit(1)))
        stop = F.least(high, start + F.pmod(F.xxhash64(slot, "doc_id"), F.lit(longest)))
        words = F.array(*map(F.lit, (" corrected", "", "\n", " 2024", "n't", "  ")))
        word = F.get(words, F.pmod(F.hash("doc_id", slot), F.lit(6)).cast("int"))
        return F.struct(start.alias("start"), F.greatest(start, stop).alias("stop"), word.alias("replacement"))

    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), edit)
