"""Token ids as packed binary matrices: best-fit decreasing with a segment tree.

Texts become ids and pieces without a shuffle; documents above the sequence length are
cut losslessly. Pieces go to shards of a bounded number of text bytes by a hash of
document and piece, so that one long document or one source fills no shard alone.
Within a shard, pieces are placed by falling length; a segment tree over capacities finds the
fullest sequence that still has room. Each sequence is one row of the id matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from searchlab.llm.tokens import END_ID, default_tokenizer, text_bytes, token_pieces

SHARD_BYTES = 4 * 2**20
SCHEMA = (
    "shard long, sequence int, n_tokens int, ids binary, cu_seqlens array<int>, "
    "position_ids binary, doc_ids array<{}>, starts array<long>"
)


class CapacityTree:
    """Segment tree over capacities 0..n; a leaf counts the open sequences with that room."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def successor(self, least: int) -> int | None:
        """Smallest capacity of at least ``least`` that has a sequence."""
        node = least + self.size
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of each sequence, best fit by falling length, ties by number."""
    tree, open_with, sequences = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        room = tree.successor(length)
        if room is None:
            sequence, room = len(sequences), capacity
            sequences.append([])
        else:
            sequence = open_with[room].pop()
            tree.add(room, -1)
        sequences[sequence].append(item)
        if room > length:
            open_with[room - length].append(sequence)
            tree.add(room - length, 1)
    return sequences


def packed_matrix(
    docs: DataFrame,
    seq_len: int = 2048,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    pad_id: int = 0,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each packed sequence.

    ``ids``: ``seq_len`` little-endian unsigned 32-bit ids, ``pad_id`` after the last
    segment; ``cu_seqlens``: 0 and the end of each segment; ``position_ids``: unsigned
    32-bit positions that restart at 0 with each segment (0 in the padding); ``doc_ids`` and
    ``starts``: document and first id of each segment, so that texts can be put together
    again. Sequences are numbered within their shard. Null and empty texts give ``end_id``
    alone, null ids of rows stay null, repeated rows are packed as often as they come, an
    empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    shards = max(1, -(-text_bytes(docs, text_col) // shard_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = token_pieces(docs, seq_len, path, end_id, True, id_col, text_col).select(
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard"),
        "doc_id", "piece", "start", "length", "ids",
    )

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = part["length"].to_numpy()
        doc_ids, starts = part["doc_id"].combine_chunks(), part["start"].to_numpy()
        data = part["ids"].combine_chunks()
        sequences = pack_lengths(lengths, seq_len)
        steps = np.arange(seq_len, dtype="<u4")
        ids, positions, bounds = [], [], []
        for items in sequences:
            ends = np.cumsum(lengths[items])
            row = np.full(seq_len, pad_id, dtype="<u4")
            row[: ends[-1]] = np.frombuffer(b"".join(data[i].as_py() for i in items), dtype="<u4")
            places = np.zeros(seq_len, dtype="<u4")
            for end, n in zip(ends, lengths[items]):
                places[end - n : end] = steps[:n]
            ids.append(row.tobytes())
            positions.append(places.tobytes())
            bounds.append(np.concatenate([[0], ends]).astype("int32"))
        order = np.array([i for items in sequences for i in items], dtype="int64")
        at = np.cumsum([0, *map(len, sequences)]).astype("int32")
        n = len(sequences)
        return pa.table({
            "shard": pa.array(np.full(n, part["shard"][0].as_py(), dtype="int64")),
            "sequence": pa.array(np.arange(n, dtype="int32")),
            "n_tokens": pa.array(np.array([b[-1] for b in bounds], dtype="int32")),
            "ids": pa.array(ids, pa.binary()),
            "cu_seqlens": pa.array(bounds, pa.list_(pa.int32())),
            "position_ids": pa.array(positions, pa.binary()),
            "doc_ids": pa.ListArray.from_arrays(pa.array(at), doc_ids.take(pa.array(order))),
            "starts": pa.ListArray.from_arrays(pa.array(at), pa.array(starts[order])),
        })

    return pieces.groupBy("shard").applyInArrow(pack, SCHEMA.format(kind))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrix rows; ``read_block`` gives a file's rows as numpy arrays."""
    packed.write.parquet(path)


def read_blocks(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and positions of collected rows as arrays."""
    for row in rows:
        yield np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["position_ids"], "<u4")
