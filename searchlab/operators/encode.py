"""Text -> vector with an encoder that is built once per task.

An encoder is any object with ``dimension`` and ``encode(list of texts) -> matrix``;
a sentence model fits as well as the hashed bag of words shipped here.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

DIMENSION = 128
BATCH = 32
WORD = re.compile(r"[^\W_]+")


class HashedEncoder:
    """Signed hashed bag of words, ``1 + ln(tf)`` per word, unit length."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self._slots: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        """Position from 1, with the word's sign."""
        slot = self._slots.get(word)
        if slot is None:
            digest = hashlib.md5(word.encode()).hexdigest()
            slot = (int(digest[:8], 16) % self.dimension + 1) * (1 if digest[-1] < "8" else -1)
            if len(self._slots) < 1_000_000:  # memory bound of the task
                self._slots[word] = slot
        return slot

    def encode(self, texts: list[str]) -> np.ndarray:
        matrix, known = np.zeros((len(texts), self.dimension)), self._slots
        for number, text in enumerate(texts):
            counts = Counter(WORD.findall(text.lower()))
            slots = np.array([known.get(word) or self._slot(word) for word in counts], "int64")
            weights = np.sign(slots) * (1.0 + np.log(np.fromiter(counts.values(), "f8", len(counts))))
            matrix[number] = np.bincount(np.abs(slots) - 1, weights, self.dimension)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms == 0, 1.0, norms)


def encode_texts(
    df: DataFrame,
    keep: list[str],
    text: Column,
    prefix: str = "",
    encoder: Callable[[], object] = HashedEncoder,
    vec_col: str = "embedding",
    batch: int = BATCH,
) -> DataFrame:
    """``keep`` columns + ``vec_col``.

    Texts are placed by key first: encoding costs far more than moving the text, and
    every core gets its share however the files were cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for records in batches:
            texts = records.column(records.num_columns - 1).to_pylist()
            parts = [model.encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            if not parts:
                continue
            matrix = np.concatenate(parts)
            offsets = pa.array(np.arange(len(matrix) + 1, dtype="int32") * matrix.shape[1])
            column = pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))
            position = records.num_columns - 1
            yield records.set_column(position, vec_col, column)

    vector = T.StructField(vec_col, T.ArrayType(T.DoubleType()))
    schema = T.StructType([*[df.schema[c] for c in keep], vector])
    prefixed = F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))
    texts = df.select(*keep, prefixed.alias("_text")).repartition(*keep)
    return texts.mapInArrow(run, schema)
