"""Benchmark decontamination: approximate occurrences of test items inside documents.

An item of m characters may differ from a passage by ``rate * m`` edits (k). It is cut into
k + 1 pieces; by the pigeonhole principle at least one piece occurs unchanged in
every such passage. All pieces of a block of items are looked up in one pass over a text
(Aho-Corasick); around each hit, Myers' bit-parallel algorithm finds the least edit
distance of the item to any passage of the window.

The items are a query set: they are sent to the tasks in blocks of at most
``BLOCK_CHARS`` characters, one pass over the documents for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from searchlab.llm.common import document_columns

RATE = 0.08
BLOCK_CHARS = 2_000_000
_RUNS = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Lower case, runs of anything but letters and digits as one space."""
    return _RUNS.sub(" ", text.lower()).strip()


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces (start, text) of nearly equal length."""
    n = budget + 1
    bounds = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


class Pattern:
    """An item prepared for Myers' search."""

    def __init__(self, text: str):
        self.m = len(text)
        self.masks: dict[str, int] = {}
        for at, letter in enumerate(text):
            self.masks[letter] = self.masks.get(letter, 0) | 1 << at
        self.all = (1 << self.m) - 1
        self.last = 1 << (self.m - 1)

    def search(self, text: str, budget: int) -> tuple[int, int] | None:
        """(least distance, first end with it) of a passage of ``text`` within the budget."""
        masks, every, last = self.masks, self.all, self.last
        up, down, score = every, 0, self.m
        best, end = budget + 1, -1
        for at, letter in enumerate(text):
            same = masks.get(letter, 0)
            xv = same | down
            xh = (((same & up) + up) ^ up) | same
            ph = down | (every & ~(xh | up))
            mh = up & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph = (ph << 1) & every
            mh = (mh << 1) & every
            up = mh | (every & ~(xv | ph))
            down = ph & xv
            if score < best:
                best, end = score, at + 1
        return (best, end) if best <= budget else None


class Matcher:
    """All items of a block: one automaton for the pieces, one pattern for each item."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(key, text, int(rate * len(text))) for key, text in items]
        self.patterns = [Pattern(text) for _, text, _ in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, budget) in enumerate(self.items):
            for start, piece in pieces_of(text, budget):
                where.setdefault(piece, []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item, the merged ranges of text in which it may occur."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            hit = end + 1 - length
            for number, start in places:
                _, item, budget = self.items[number]
                low, high = hit - start - budget, hit - start + len(item) + budget
                ranges = found.setdefault(number, [])
                # Hits come in the order of their ends; close ones become one range.
                if ranges and low <= ranges[-1][1]:
                    ranges[-1] = (min(ranges[-1][0], low), max(ranges[-1][1], high))
                else:
                    ranges.append((low, high))
        return found

    def matches(self, text: str) -> Iterator[tuple[object, int, int]]:
        """(item, least distance, end in the plain text) of each item that occurs."""
        for number, ranges in self.windows(text).items():
            key, item, budget = self.items[number]
            same = text.find(item)
            if same >= 0:
                yield key, 0, same + len(item)
                continue
            best = None
            for low, high in ranges:
                low = max(low, 0)
                got = self.patterns[number].search(text[low:high], budget)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1])
            if best:
                yield key, *best


def _blocks(items: list[tuple[object, str]]) -> Iterator[list[tuple[object, str]]]:
    block, chars = [], 0
    for item in items:
        if block and chars + len(item[1]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(item)
        chars += len(item[1])
    yield block


def plain_items(benchmark: DataFrame, item_col: str, text_col: str) -> list[tuple[object, str]]:
    """(item, plain text) of the items that have letters or digits, in a fixed order."""
    rows = benchmark.select(item_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    items = sorted(((key, plain(text)) for key, text in rows.toLocalIterator()), key=repr)
    return [(key, text) for key, text in items if text]


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Items found in documents: doc_id, item_id, distance, end, item_length.

    Both texts are compared in plain form (see ``plain``); ``distance`` is the least
    number of edits between the whole item and any passage of the whole text, at most
    ``rate`` times the item's length; ``end`` is where the first best passage ends in
    the plain text. Null texts count as empty and match nothing, items without letters
    or digits are never found, items that repeat are found each. Repeated documents give
    repeated rows, null ids stay null, other columns are ignored; empty tables
    give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, end long, item_length int"
    source = document_columns(docs, id_col, text_col)
    items = plain_items(benchmark, item_col, item_text_col)

    def over(block: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate) if block else None
            lengths = dict(block)
            for batch in batches:
                rows: list[tuple] = []
                for row, text in enumerate(batch.column(1)):
                    if matcher:
                        rows += [(row, *found) for found in matcher.matches(plain(text.as_py()))]
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], item_type),
                        pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()),
                        pa.array([len(lengths[k]) for k in columns[1]], pa.int32()),
                    ],
                    ["doc_id", "item_id", "distance", "end", "item_length"],
                )

        return source.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(over, _blocks(items)))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no item occurs (see ``benchmark_matches``), unchanged.

    Rows are judged where they lie, without a shuffle, whatever their id.
    """
    place = docs.columns.index(text_col)

    def without(rows: DataFrame, block: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                clean = [next(matcher.matches(plain(t.as_py() or "")), None) is None for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    items = plain_items(benchmark, item_col, item_text_col)
    return reduce(without, _blocks(items), docs) if items else docs
