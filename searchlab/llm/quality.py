"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes ``FEATURES`` transformed statistics, one pass without a shuffle.
Counts, sums and products of the labelled rows are added up by Spark for each class (all
labelled training rows, no sample); the driver receives (1 + d + d * d) numbers for each class.
The covariance of a class is shrunk toward the pooled diagonal, that of a rare class more; its Cholesky factor is inverted once and
sent to the tasks, which turn Mahalanobis distances into log-density differences.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from searchlab.llm.common import document_columns, in_training
from searchlab.sources.staging import stage

THRESHOLD = 0.3
SHRINKAGE = 0.1
FLOOR = 1e-3
#: The log-density difference is scaled down before it becomes a score, since the
#: statistics are far from independent normal ones.
TEMPERATURE = 2.0
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "lower", "digit", "space", "newline",
    "bar", "bang", "hash_star", "dollar_percent", "other_symbol", "beyond_ascii",
    "distinct_words", "top_word", "distinct_lines", "symbol_words",
)
_KIND = np.zeros(256, np.int64)
for _name, _letters in (
    (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"abcdefghijklmnopqrstuvwxyz"), (3, b"0123456789"),
    (4, b" \t"), (5, b"\n\r"), (6, b"|"), (7, b"!"), (8, b"#*"), (9, b"$%&"), (10, b".,"),
):
    _KIND[list(_letters)] = _name
_KIND[128:] = 11
_KIND[(_KIND == 0)] = 12


def _log_share(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (whole + 1.0))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; defined for the empty text too."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND, np.bincount(data, minlength=256), 13) if len(data) else np.zeros(13)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    n, w = len(data), len(words)
    symbol_words = sum(c for x, c in counts.items() if not x[-1].isalnum() and x[-1] not in ".,;:")
    return [
        math.log1p(n), math.log1p(w), n / (w + 1.0) if w else 0.0,
        _log_share(kinds[1], n), _log_share(kinds[2] + kinds[11], n), _log_share(kinds[3], n),
        _log_share(kinds[4], n), _log_share(kinds[5], n), _log_share(kinds[6], n),
        _log_share(kinds[7], n), _log_share(kinds[8], n), _log_share(kinds[9], n),
        _log_share(kinds[12], n), _log_share(kinds[11], n),
        _log_share(len(counts), w) + 0.15 * math.log1p(w),
        _log_share(max(counts.values(), default=0), w),
        _log_share(len(set(lines)), len(lines)), _log_share(symbol_words, w),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return document_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and offsets of both classes, or one constant score."""

    constant: float | None = None
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log_density = [
            o - 0.5 * np.square((x - m) @ t.T).sum(axis=1)
            for m, t, o in zip(self.means, self.whiten, self.offsets)
        ]
        difference = np.clip((log_density[1] - log_density[0]) / TEMPERATURE, -500, 500)
        return 1.0 / (1.0 + np.exp(-difference))


def fit_discriminant(statistics_of: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on all labelled rows (``labels``: doc_id, quality 0 or 1; others are ignored).

    Repeated labels count each. The fewer rows a class has beside the statistics, the more its covariance is
    shrunk. Only where a class has no row at all, every score is the smoothed share of label 1.
    """
    d = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist())
            label = batch.column(1).to_numpy(zero_copy_only=False)
            one = np.hstack([np.ones((len(x), 1)), x])
            for value in np.unique(label):
                part = one[label == value]
                sums[int(value)] = sums.get(int(value), 0) + part.T @ part
        for value, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full((d + 1) ** 2, value)), pa.array(np.arange((d + 1) ** 2)),
                    pa.array(total.ravel()),
                ],
                ["label", "at", "value"],
            )

    known = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("long").alias("label"))
    rows = statistics_of.filter(in_training()).join(known, "doc_id").select("x", "label")
    sums = rows.mapInArrow(partial, "label long, at long, value double").groupBy("label", "at").agg(F.sum("value"))
    moments = np.zeros((2, (d + 1) ** 2))
    for label, at, value in sums.collect():
        moments[label, at] = value
    moments = moments.reshape(2, d + 1, d + 1)
    n = moments[:, 0, 0]
    if not n.min():
        return Discriminant(constant=float((n[1] + 1) / (n.sum() + 2)))
    means = moments[:, 0, 1:] / n[:, None]
    covariance = np.array([
        moments[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)
    ])
    pooled = np.diag(np.tensordot(n / n.sum(), covariance, 1).diagonal() + FLOOR)
    whiten, offsets = [], []
    for k in (0, 1):
        shrunk = shrinkage + (1 - shrinkage) * d**2 / (d**2 + n[k] ** 2)
        factor = np.linalg.cholesky((1 - shrunk) * covariance[k] + shrunk * pooled)
        whiten.append(np.linalg.inv(factor))
        offsets.append(math.log(n[k] / n.sum()) - np.log(factor.diagonal()).sum())
    return Discriminant(None, means, np.array(whiten), np.array(offsets))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Only the text enters a score. Labels are learnt from rows whose id's crc32 is no multiple
    of 5. Null and empty texts have the statistics of the empty text and are scored
    like any other; a null id is held out. Repeated rows are scored each; columns other than
    id and text are ignored; no documents give no rows.
    """
    known = stage(document_statistics(docs, id_col, text_col), "statistics")
    model = fit_discriminant(known, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    kind = known.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (~in_training()).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, unchanged.

    Rows are scored where they lie, without a shuffle, whatever their id.
    """
    model = fit_discriminant(stage(document_statistics(docs, id_col, text_col), "statistics"), labels)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(place)]
            scores = model.score(np.array(rows).reshape(-1, len(FEATURES)))
            yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
