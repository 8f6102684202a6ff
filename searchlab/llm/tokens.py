"""Token ids of whole texts, cut into pieces, as Arrow batches.

Ids are those of the ``tokenizers`` library for the given vocabulary file. For texts
whose characters all lie below U+0250 the same vocabulary is read by ``tiktoken``, which
is several times faster and gives the same ids there (tested over the whole range);
every other text goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from searchlab.llm.common import document_columns

#: Split pattern of the byte-level vocabulary; a fixed value of its format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 2
DOCS_AT_ONCE = 256
_BEYOND = re.compile("[^\x00-ɏ]")
_ENCODERS: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.fast = None
        ranks_path = re.sub(r"\.json$", ".tiktoken", path)
        if ranks_path != path and os.path.exists(ranks_path):
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
            )

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not _BEYOND.search(text):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids

    @staticmethod
    def of(path: str) -> "Encoder":
        """One encoder for each worker process and file."""
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole pieces, a shorter one first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame,
    capacity: int = 1024,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    keep_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32[, ids].

    Every row gives its text's ids and ``end_id`` (null text: empty, so ``end_id`` alone).
    ``ids`` are little-endian unsigned 32-bit numbers. Null ids of rows stay null.
    Repeated rows give repeated pieces; no row, no piece.
    """
    path = tokenizer or default_tokenizer()
    source = document_columns(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(at, DOCS_AT_ONCE)
                rows: list[int] = []
                out: list[list] = [[], [], [], [], []]
                for row, text in enumerate(batch.column(1)):
                    ids = np.array([*encoder.ids(text.as_py()), end_id], dtype="<u4")
                    for number, (start, length) in enumerate(cuts(len(ids), capacity)):
                        data = ids[start : start + length].tobytes()
                        rows.append(row)
                        values = (number, start, length, zlib.crc32(data), data)
                        for column, value in zip(out, values):
                            column.append(value)
                arrays = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(out[0], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in out[1:4]),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(out[4], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, schema)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, one pass without Python."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0]
    return int(total or 0)
