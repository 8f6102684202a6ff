"""Best-fit packing of pieces into sequences of a fixed capacity; the sweep over lengths runs on the driver.

Documents are range-sorted by length; a document's rank among those of equal length comes
from the counts of the sorted partitions, so no group is gathered. Gaps are kept sorted by
capacity as runs: consecutive sequences with the same room are one run. In each step the
documents of one length class meet their successors, the runs with the smallest capacity
that holds them; conflicts are resolved by rank (document i of the class takes place
i of the run), runs get their new capacity, and the next class follows, until all are
placed. A class that finds no gap opens new sequences. All the classes of a length give
the state of an ordinary best-fit-decreasing pass, so the number of sequences is the same.

Spark sorts, ranks and places; the steps themselves are one sequential loop on the driver, in place of
a distributed sweep, which would need a job for each length class.

What the driver sees is one count for each length and sorted partition, and the runs.
Both are bounded by the capacity and the number of partitions, not by the documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window, functions as F

from searchlab.llm.common import small_table
from searchlab.sources.staging import stage

MATCHES = "length long, from_rank long, to_rank long, first_sequence long, each long, used long"


class Gaps:
    """Runs of consecutive sequences with equal room, sorted by room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.opened = 0

    def add(self, room: int, first: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if room not in self.runs:
            insort(self.rooms, room)
            self.runs[room] = []
        self.runs[room].append((first, count))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """The run with the least room that holds the length: (room, first, count)."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            del self.rooms[at]
        return room, first, count

    def open(self, count: int) -> tuple[int, int, int]:
        first, self.opened = self.opened, self.opened + count
        return self.capacity, first, count


def sweep(counts: dict[int, int], capacity: int) -> list[dict]:
    """Matches of rank ranges of each length class with runs of sequences."""
    gaps, matches = Gaps(capacity), []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = capacity // length
            room, first, count = gaps.take(length) or gaps.open(-(-left // fits))
            each = room // length
            placed = min(left, each * count)
            whole, rest = divmod(placed, each)
            matches.append({
                "length": length, "from_rank": rank, "to_rank": rank + placed,
                "first_sequence": first, "each": each, "used": capacity - room,
            })
            gaps.add(room - each * length, first, whole)
            gaps.add(room - rest * length, first + whole, 1 if rest else 0)
            used = whole + (1 if rest else 0)
            gaps.add(room, first + used, count - used)
            rank, left = rank + placed, left - placed
    return matches


def ranked(items: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, dict[int, int]]:
    """Items with their rank among items of equal length, and the count of each length."""
    order = F.xxhash64(*keys)
    # Range partitioning reads its input twice, once for the bounds: written first.
    items = stage(items, f"{name}_input")
    sorted_items = stage(
        items.repartitionByRange(F.desc("length"), order)
        .sortWithinPartitions(F.desc("length"), order, *keys)
        .withColumn("place", F.monotonically_increasing_id()),
        name,
    ).withColumn("part", F.shiftright("place", 33))
    parts = sorted_items.groupBy("length", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place")
    )
    parts = stage(parts, f"{name}_parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "length", "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_place")).alias("shift"),
    )
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("n")).collect()}
    with_rank = sorted_items.join(offsets, ["length", "part"]).withColumn(
        "rank", F.col("place") + F.col("shift")
    )
    return with_rank.drop("place", "part", "shift"), counts


def best_fit(items: DataFrame, keys: list[str], capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items`` (``keys``, ``length``).

    ``length`` is between 1 and ``capacity``; other lengths are refused. Sequences are
    numbered from 0, places within a sequence are gapless from 0. Ties of length are
    ordered by a hash of the keys; items with equal keys and length share the ranks in any
    order, which gives the same sequences. Only the key columns, other columns of
    ``items`` and the two new ones are returned; ``items`` must not itself have columns
    named sequence_id, offset, place, part, shift, rank, n or those of a match. No items
    give no rows.
    """
    spark = items.sparkSession
    with_rank, counts = ranked(items, keys, "sorted_pieces")
    wrong = [x for x in counts if x is None or not 0 < x <= capacity]
    if wrong:
        raise ValueError(f"lengths outside 1..{capacity}: {sorted(map(str, wrong))[:5]}")
    matches = small_table(spark, sweep(counts, capacity), MATCHES)
    place = F.col("rank") - F.col("from_rank")
    inside = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    # Equi-join on the length; of a class's matches exactly one holds the rank.
    matches = matches.withColumnRenamed("length", "match_length")
    joined = with_rank.join(matches, (F.col("length") == F.col("match_length")) & inside)
    return joined.select(
        *items.columns,
        (F.col("first_sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("used") + (place % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
