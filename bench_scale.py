"""The published workload: 500,000 documents, 384 dimensions, 25 queries, top 20.

Vectors and texts are made by Spark from a row number, written once to a scratch
folder and searched from there. ``python bench_scale.py [rows] [folder]``
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from searchlab.operators import ann, lexical, reduction
from searchlab.operators.dense import exact_top_k
from searchlab.sources.staging import stage
from tests.session import local_session

WIDTH = 384
QUERIES = 25


def make_vectors(spark: SparkSession, rows: int) -> DataFrame:
    """Unit vectors around 200 centres with falling variance per axis."""

    def vectors(batches):
        centres = np.random.default_rng(0).normal(size=(200, WIDTH))
        scale = 1.0 / np.sqrt(np.arange(1, WIDTH + 1))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rng = np.random.default_rng(int(ids[0]) + 1)
            matrix = (centres[ids % 200] + rng.normal(size=(len(ids), WIDTH))) * scale
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            offsets = pa.array(np.arange(len(ids) + 1, dtype="int32") * WIDTH)
            values = pa.ListArray.from_arrays(offsets, pa.array(matrix.astype("f4").ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "embedding"])

    return spark.range(0, rows, 1, 32).toDF("doc_id").mapInArrow(
        vectors, "doc_id bigint, embedding array<float>"
    )


def make_texts(spark: SparkSession, rows: int) -> DataFrame:
    """Postings of 5 + 15 + 150 words with a Zipf-like vocabulary of 50,000."""

    def words(count: int, seed: int):
        draws = [F.pow(F.lit(50_000.0), F.rand(seed + i)).cast("int") for i in range(count)]
        return F.concat_ws(" ", *[F.concat(F.lit("w"), d) for d in draws])

    return spark.range(0, rows, 1, 32).select(
        F.col("id").alias("doc_id"),
        words(5, 1).alias("title"),
        words(15, 101).alias("skills"),
        words(150, 1001).alias("summary"),
    )


def timed(times: dict, name: str, action) -> object:
    start = time.perf_counter()
    result = action()
    times[name] = round(time.perf_counter() - start, 3)
    print(name, times[name], file=sys.stderr, flush=True)
    return result


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 500_000
    folder = Path(sys.argv[2] if len(sys.argv) > 2 else "/tmp/searchlab-scale")
    spark = local_session()
    if not (folder / "vectors" / "_SUCCESS").exists():
        make_vectors(spark, rows).write.mode("overwrite").parquet(str(folder / "vectors"))
    if not (folder / "texts" / "_SUCCESS").exists():
        make_texts(spark, rows).write.mode("overwrite").parquet(str(folder / "texts"))
    vectors = spark.read.parquet(str(folder / "vectors"))
    asked = spark.createDataFrame(
        [
            (f"Q{r['doc_id']}", r["embedding"])
            for r in vectors.filter(F.col("doc_id") < QUERIES).collect()
        ],
        "query_id string, qvec array<float>",
    )
    times: dict[str, float] = {}
    timed(times, "first_exact_search", lambda: exact_top_k(vectors, asked).collect())
    timed(times, "exact_search", lambda: exact_top_k(vectors, asked).collect())
    pivots = timed(times, "pivots", lambda: stage(ann.pivot_centroids(vectors, 256), "pivots"))
    timed(times, "cell_build", lambda: ann.write_cells(
        ann.assign_cells(vectors, pivots), str(folder / "cells")))
    cells = ann.read_cells(spark, str(folder / "cells"))
    timed(times, "cell_search_nprobe_8",
          lambda: ann.search_cells(cells, asked, pivots, [8]).collect())
    exact = exact_top_k(vectors, asked)
    found = ann.search_cells(cells, asked, pivots, [4, 8, 16, 32])
    recall = {r["nprobe"]: round(r["ann_recall_at_10"], 3)
              for r in ann.recall_against_exact(exact, found).collect()}
    model, _ = timed(times, "pca_fit_256", lambda: reduction.fit_pca(vectors, 256))
    timed(times, "pca_transform_128", lambda: reduction.project(vectors, model, 128)
          .withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(str(folder / "small")))
    small = spark.read.parquet(str(folder / "small"))
    small_asked = reduction.project(asked, model, 128, "qvec")
    timed(times, "reduced_search_128", lambda: exact_top_k(small, small_asked).collect())

    texts = spark.read.parquet(str(folder / "texts"))
    index = timed(times, "bm25_index", lambda: lexical.write_index(texts, str(folder / "index")))
    questions = spark.createDataFrame(
        [(f"Q{i}", " ".join(f"w{int(50_000 ** (((i * 7 + j * 13) % 89) / 89))}" for j in range(9)))
         for i in range(QUERIES)],
        "query_id string, query string",
    )
    timed(times, "first_bm25_search", lambda: lexical.search_bm25(index, questions).collect())
    timed(times, "bm25_search", lambda: lexical.search_bm25(index, questions).collect())
    print(json.dumps({"rows": rows, "seconds": times, "recall_at_10": recall}))
    spark.stop()


if __name__ == "__main__":
    main()
