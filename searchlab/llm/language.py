"""Language identification by a small convolutional network over bytes.

Windows of ``WINDOW`` bytes go through an embedding, filters of several widths, max pooling over
the window and a softmax. The network is trained with numpy on the driver, on a bounded sample
of labelled rows, which are windows: about ``windows_per_language`` of all windows of each language's
whole texts, chosen by a hash of id and place. It is applied to
every window of every whole text; a document gets the mean of its windows' logits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from searchlab.llm.common import document_columns, in_training

WINDOW = 256
EMBEDDING = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
WINDOWS_PER_LANGUAGE = 6000
HASHES = 2**63
STEPS = 400
BATCH = 96
RATE = 0.01
WINDOWS_AT_ONCE = 64
UNKNOWN = "und"


def windows_of(text: str) -> np.ndarray:
    """All windows of a whole text, (n, WINDOW) bytes; the last one is filled with zeros."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class ByteNetwork:
    """Embedding, filters by width, output layer; languages in the order of the outputs."""

    languages: list[str]
    parameters: dict[str, np.ndarray]
    tables: list = field(default_factory=list)

    @classmethod
    def new(cls, languages: list[str]) -> "ByteNetwork":
        random = np.random.default_rng(7)
        made = {"embedding": random.normal(0, 0.5, (256, EMBEDDING))}
        for width in WIDTHS:
            made[f"filter{width}"] = random.normal(0, 0.5, (width, EMBEDDING, FILTERS))
        made["out"] = random.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        made["bias"] = np.zeros(len(languages))
        return cls(languages, made)

    def train(self, windows: np.ndarray, labels: np.ndarray) -> "ByteNetwork":
        """Adam on the cross-entropy; only the pooled places pass a gradient back."""
        random = np.random.default_rng(11)
        p = self.parameters
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, STEPS + 1):
            chosen = random.integers(0, len(windows), BATCH)
            x, target = windows[chosen].astype(np.int64), labels[chosen]
            pooled, places = [], []
            for width in WIDTHS:
                length = WINDOW - width + 1
                total = sum((p["embedding"] @ p[f"filter{width}"][j])[x[:, j : j + length]] for j in range(width))
                places.append(total.argmax(axis=1))
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.hstack(pooled), 0)
            logits = hidden @ p["out"] + p["bias"]
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(BATCH), target] -= 1
            chance /= BATCH
            gradient = {"out": hidden.T @ chance, "bias": chance.sum(axis=0)}
            back = (chance @ p["out"].T) * (hidden > 0)
            gradient["embedding"] = np.zeros_like(p["embedding"])
            for number, width in enumerate(WIDTHS):
                own = back[:, number * FILTERS : (number + 1) * FILTERS]
                kernel = p[f"filter{width}"]
                slope = np.zeros_like(kernel)
                for j in range(width):
                    letters = np.take_along_axis(x, places[number] + j, axis=1)
                    slope[j] = np.einsum("bfe,bf->ef", p["embedding"][letters], own)
                    np.add.at(gradient["embedding"], letters, own[:, :, None] * kernel[j].T)
                gradient[f"filter{width}"] = slope
            for name, slope in gradient.items():
                first[name] += 0.1 * (slope - first[name])
                second[name] += 0.001 * (slope**2 - second[name])
                rate = RATE * (1 - 0.7 * step / STEPS)
                p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def prepared(self) -> "ByteNetwork":
        """Filters as tables over byte pairs: a filter of width 4 is the sum of two pairs."""
        if not self.tables:
            for width in WIDTHS:
                kernel = self.parameters[f"filter{width}"]
                by_byte = [(self.parameters["embedding"] @ k).astype(np.float32) for k in kernel]
                parts = [
                    (by_byte[j][:, None] + by_byte[j + 1][None, :]).reshape(-1, FILTERS)
                    for j in range(0, width - 1, 2)
                ]
                self.tables.append((width, parts, by_byte[-1] if width % 2 else None))
        return self

    def logits(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)))
        for at in range(0, len(windows), WINDOWS_AT_ONCE):
            x = windows[at : at + WINDOWS_AT_ONCE]
            pairs = x[:, :-1].astype(np.int64) * 256 + x[:, 1:]
            pooled = []
            for width, parts, single in self.tables:
                length = WINDOW - width + 1
                total = np.take(parts[0], pairs[:, :length], axis=0)
                for number, part in enumerate(parts[1:], 1):
                    total += np.take(part, pairs[:, 2 * number : 2 * number + length], axis=0)
                if single is not None:
                    total += np.take(single, x[:, width - 1 :], axis=0)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.hstack(pooled), 0)
            out[at : at + len(x)] = hidden @ self.parameters["out"] + self.parameters["bias"]
        return out


def hash_limit(wanted: int, there: int) -> int:
    """Largest of the ``HASHES`` hash values that belongs to ``wanted`` of ``there`` rows."""
    return min(HASHES * wanted // there, HASHES) - 1


def training_windows(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, windows_per_language: int
) -> tuple[np.ndarray, list[str]]:
    """Windows and labels of the bounded sample, drawn from all windows of the training rows."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(lang_col).alias("lang"),
    ).filter(in_training() & F.col("lang").isNotNull())
    windows = F.greatest(F.ceil(F.octet_length("text") / WINDOW), F.lit(1)).cast("int")
    rows = rows.withColumn("windows", windows)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum("windows")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    limit = F.create_map(*[
        F.lit(x) for lang, n in counts.items() for x in (lang, hash_limit(windows_per_language, n))
    ])
    place = F.sequence(F.lit(0), F.col("windows") - 1)
    drawn = F.filter(
        place, lambda i: F.xxhash64("doc_id", i).bitwiseAND(F.lit(HASHES - 1)) <= F.col("limit")
    )
    chosen = rows.withColumn("limit", limit[F.col("lang")]).withColumn("drawn", drawn).filter(F.size("drawn") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for text, lang, drawn in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if has_letter(text):
                    whole = windows_of(text)
                    found += [whole[i].tobytes() for i in drawn]
                    langs += [lang] * len(drawn)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "bytes"])

    got = chosen.select("text", "lang", "drawn").mapInArrow(cut, "lang string, bytes binary").toArrow()
    pairs = sorted(zip(got["lang"].to_pylist(), got["bytes"].to_pylist()))
    return np.frombuffer(b"".join(b for _, b in pairs), np.uint8).reshape(-1, WINDOW), [x for x, _ in pairs]


def train_network(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    windows_per_language: int = WINDOWS_PER_LANGUAGE,
) -> ByteNetwork | None:
    """A network for the languages of the training rows; none where there are no such rows."""
    windows, labels = training_windows(docs, id_col, text_col, lang_col, windows_per_language)
    languages = sorted(set(labels))
    if not languages:
        return None
    places = {x: i for i, x in enumerate(languages)}
    return ByteNetwork.new(languages).train(windows, np.array([places[x] for x in labels]))


def predict_languages(
    docs: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a learnt language, ``und`` with score 0 where the text is null or has no letter
    (or nothing was learnt). ``score`` is the softmax of the mean logits of all windows.
    A null id is held out; repeated rows are predicted each; other columns are
    ignored; no documents give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = network.prepared() if network else None
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = batch.column(1).to_pylist()
                known = [ready is not None and has_letter(t) for t in texts]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                cut = [windows_of(t) for t, k in zip(texts, known) if k]
                if cut:
                    logits = ready.logits(np.vstack(cut))
                    starts = np.cumsum([0, *map(len, cut)])
                    means = np.add.reduceat(logits, starts[:-1], axis=0) / np.diff(starts)[:, None]
                    chance = np.exp(means - means.max(axis=1, keepdims=True))
                    chance /= chance.sum(axis=1, keepdims=True)
                    for row, values in zip(np.flatnonzero(known), chance):
                        best = int(values.argmax())
                        langs[row], scores[row] = ready.languages[best], float(values[best])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return document_columns(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    ).select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score")
