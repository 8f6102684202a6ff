"""Alignment of the tokens of two tokenizers by their byte ends.

Both token lists of a text give increasing lists of byte ends. The shorter list is looked up in
the longer one by galloping: steps that double from the place of the last chunk, then
binary search inside the last step. Common ends cut both lists into groups; how far the ranks
of one common end lie from those of the next one is what tokens of either side a group holds.
The tokens that end at a common end are linked.

How often two ids are linked in the whole corpus is counted over blocks of documents: a
block holds each of its pairs once, with its documents' links as places in that list. Counts
of equal pairs are summed by Spark and go back to the blocks by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from searchlab.llm.common import document_columns
from searchlab.llm.tokens import Encoder, default_tokenizer
from searchlab.sources.staging import stage

BLOCK_DOCS, BLOCK_CHARS = 1024, 4_000_000
CHUNK = 1024
WORD_START = "▁"
AFTER = ",|;"  # after a token; after the last first-side and second-side one of a group
_SIDES: dict[tuple[str, str], tuple["ByteLevel", "Pieces"]] = {}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_characters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes are their own
    characters, the others take the characters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Side:
    """Ids of texts and the bytes of each id."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.written = np.array([f"{i}{c}" for i in range(len(entries)) for c in AFTER], object)

    def covers(self, ids: np.ndarray, text: bytes) -> bool:
        return int(self.lengths[ids].sum()) == len(text) and b"".join(map(self.entries.__getitem__, ids.tolist())) == text


class ByteLevel(_Side):
    """A byte-level BPE vocabulary file; a space goes before the text."""

    def __init__(self, path: str):
        self.encoder = Encoder.of(path)
        byte_of = byte_characters()
        entries = [b""] * self.encoder.full.get_vocab_size(with_added_tokens=True)
        for entry, number in self.encoder.full.get_vocab(with_added_tokens=True).items():
            if all(c in byte_of for c in entry):
                entries[number] = bytes(byte_of[c] for c in entry)
        super().__init__(entries)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoder.ids(" " + text), np.int64)


class Pieces(_Side):
    """A sentencepiece model, which puts the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        entries = []
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            whole = self.model.is_byte(number)
            entries.append(bytes([int(piece[3:5], 16)]) if whole else piece.replace(WORD_START, " ").encode())
        super().__init__(entries)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


def sides(byte_level: str, pieces: str) -> tuple[ByteLevel, Pieces]:
    """Both vocabularies, read once by each worker process."""
    key = byte_level, pieces
    if key not in _SIDES:
        _SIDES[key] = ByteLevel(byte_level), Pieces(pieces)
    return _SIDES[key]


def _gallop(shorter: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two increasing lists."""
    n, at = len(longer), 0
    in_shorter, in_longer = [], []
    for start in range(0, len(shorter), CHUNK):
        wanted = shorter[start : start + CHUNK]
        # Everything before ``low`` is smaller, ``high`` is not (or the end).
        low, high = np.full(len(wanted), at), np.full(len(wanted), n)
        step, going = 1, 0  # the values from ``going`` on still gallop, as they increase
        while going < len(wanted) and at + step <= n:
            probe = at + step - 1
            stops = going + int(np.searchsorted(wanted[going:], longer[probe], side="right"))
            high[going:stops] = probe
            low[stops:] = probe + 1
            going, step = stops, 2 * step
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (longer[np.minimum(middle, n - 1)] < wanted)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        hit = low < n
        hit &= longer[np.minimum(low, n - 1)] == wanted
        in_shorter.append(start + np.flatnonzero(hit))
        in_longer.append(low[hit])
        at = int(low[-1])
    return np.concatenate(in_shorter), np.concatenate(in_longer)


def common_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two increasing lists (neither empty) of the values that both have."""
    if len(a) <= len(b):
        return _gallop(a, b)
    return _gallop(b, a)[::-1]


def _last_places(ends: np.ndarray) -> np.ndarray:
    """The last place of every different value of a list that never falls."""
    return np.flatnonzero(np.append(ends[1:] != ends[:-1], True))


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last places of every group in both lists, and the linked places of both.

    A token without bytes ends where the one before it does: it belongs to that group, and all
    tokens with one end are linked.
    """
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    a_last, b_last = _last_places(a_ends), _last_places(b_ends)
    in_a, in_b = common_places(a_ends[a_last], b_ends[b_last])
    cut_a, cut_b = a_last[in_a], b_last[in_b]
    if len(a_last) == len(a_ends) and len(b_last) == len(b_ends):
        return cut_a, cut_b, cut_a, cut_b
    firsts = [np.searchsorted(ends, ends[cut]) for ends, cut in ((a_ends, cut_a), (b_ends, cut_b))]
    pairs = [
        (i, j) for x, y, u, v in zip(firsts[0], cut_a, firsts[1], cut_b) for i in range(x, y + 1) for j in range(u, v + 1)
    ]
    linked = np.array(pairs, np.int64).reshape(-1, 2)
    return cut_a, cut_b, linked[:, 0], linked[:, 1]


def groups_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, one: _Side, two: _Side) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of both lists group by group."""
    places = np.arange(len(cut_a))
    group_a, group_b = (np.repeat(places, np.diff(cut, prepend=-1)) for cut in (cut_a, cut_b))
    before = np.concatenate([[0], cut_b[:-1] + 1])
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[cut_a], mark_b[cut_b] = 1, 2
    written = np.empty(len(a) + len(b), object)
    written[np.arange(len(a)) + before[group_a]] = one.written[3 * a + mark_a]
    written[np.arange(len(b)) + cut_a[group_b] + 1] = two.written[3 * b + mark_b]
    return "".join(written.tolist())[:-1]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of bounded rows and characters."""
    start, size = 0, 0
    for row, text in enumerate(batch.column(1)):
        if row > start and (row - start >= BLOCK_DOCS or size >= BLOCK_CHARS):
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += len(text.as_py())
    if batch.num_rows > start:
        yield batch.slice(start)


def _align_block(block: pa.RecordBatch, one: ByteLevel, two: Pieces) -> dict:
    """Columns of the block's row but its number."""
    figures: list[list] = [[], [], [], [], []]
    links = []
    for text in block.column(1):
        text = text.as_py()
        whole = (" " + text).encode()
        a, b = (one.ids(text), two.ids(text)) if text else (np.empty(0, np.int64),) * 2
        if not text or not one.covers(a, whole) or not two.covers(b, whole):
            values = 0, 0, 0, 0, ""
            links.append(np.empty(0, np.int64))
        else:
            cut_a, cut_b, link_a, link_b = align(one.lengths[a], two.lengths[b])
            links.append(a[link_a] << 32 | b[link_b])
            digest = hashlib.sha256(groups_text(a, b, cut_a, cut_b, one, two).encode()).hexdigest()
            values = len(a), len(b), len(cut_a), len(link_a), digest
        for column, value in zip(figures, values):
            column.append(value)
    pairs, places, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
    kind = _place_type(len(pairs))
    cuts = np.cumsum([len(x) for x in links])[:-1]
    return {
        "doc_id": block.column(0).to_pylist(), "n_a": figures[0], "n_b": figures[1], "n_groups": figures[2],
        "n_links": figures[3], "groups_sha256": figures[4],
        "links": [p.astype(kind).tobytes() for p in np.split(places, cuts)], "pairs": pairs, "counts": counts,
    }


def _place_type(n: int) -> str:
    """How places in a list of ``n`` pairs are written."""
    return "<u2" if n <= 2**16 else "<u4"


def _arrow_lists(columns: dict, kinds: dict[str, pa.DataType]) -> list[pa.Array]:
    return [pa.array([columns[name]], pa.list_(kind)) for name, kind in kinds.items()]


def align_blocks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row for each block: its documents' figures and links, its pairs with their counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"block long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "groups_sha256 array<string>, links array<binary>, pairs array<long>, counts array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            kinds = {"doc_id": batch.schema.field(0).type} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64())
            kinds |= {"groups_sha256": pa.string(), "links": pa.binary(), "pairs": pa.int64(), "counts": pa.int64()}
            for block in _blocks(batch):
                columns = _align_block(block, one, two)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *_arrow_lists(columns, kinds)], ["block", *kinds])
                number += 1

    return docs.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair, whether no pair of its second id has more."""
    counted = (
        blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.counts").alias("n"))
    )
    second = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1)))
    return counted.withColumn("best", F.col("n") == F.max("n").over(second))


def _document_rows(blocks: DataFrame) -> DataFrame:
    """One row for each document of blocks with ``found``, the sorted (place, n, best) of their pairs."""
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].values for name in [*names, "doc_id", "groups_sha256", "links"]}
                found = batch.column("found")[row].values
                found = [] if found is None else found
                n = found.field("n").to_numpy() if len(found) else np.empty(0, np.int64)
                best = found.field("best").to_numpy(zero_copy_only=False) if len(found) else np.empty(0, bool)
                places = [np.frombuffer(x.as_py(), _place_type(len(n))) for x in one["links"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        one["doc_id"], *(one[name] for name in names),
                        pa.array([int(best[p].sum()) for p in places], pa.int64()),
                        pa.array([int(n[p].sum()) for p in places], pa.int64()), one["groups_sha256"],
                    ],
                    ["doc_id", *names, "n_best", "count_sum", "groups_sha256"],
                )

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.mapInArrow(run, schema)


def aligned_tokens(
    docs: DataFrame,
    byte_level: str | None = None,
    pieces: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first tokenizer is a byte-level BPE file, which reads the text behind a space, the second a
    sentencepiece model, which puts that space itself; special tokens inside texts are plain
    text. ``n_groups`` groups lie between ends of both, ``n_links`` pairs of tokens end together;
    ``count_sum`` sums over them how often their ids are linked in the whole corpus, ``n_best`` are
    those whose count is the largest of their second id (ties included).
    ``groups_sha256`` is the digest of ``groups_text``.

    A text that is null, empty or that the tokens do not give back byte by byte has zeros
    and an empty digest. Null and repeated ids are rows like others, each counts. Other
    columns are ignored; an empty table gives no rows.
    """
    source = document_columns(docs, id_col, text_col)
    blocks = stage(align_blocks(source, byte_level or default_tokenizer(), pieces or default_pieces()), "aligned_blocks")
    counts = stage(pair_counts(blocks), "pair_counts")
    found = (
        blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
        .join(counts.hint("merge"), "pair")
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("found"))
    )
    return _document_rows(blocks.drop("pairs", "counts").join(found.hint("merge"), "block", "left"))
