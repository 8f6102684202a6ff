"""Headline queries on the driver's tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from searchlab.plans.catalog import QUERIES
from tests.session import local_session

HEADLINE = [
    "clean_text",
    "stratified_sample",
    "build_corpus",
    "length_describe",
    "bm25_postings",
    "bm25_topk",
    "encode_texts",
    "dense_exact_topk",
    "dense_reduced_topk",
    "ivf_topk",
    "ann_sweep",
    "explained_variance",
    "annotation_pool",
    "rrf_fusion",
    "metrics_per_query",
    "summary_by_system",
    "latency_stats",
    "evaluation_end_to_end",
]


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    for name in ("bm25_topk", "dense_exact_topk"):  # start JVM code paths and workers
        seconds(spark, name, str(Path(folder).parent / "sf0.001"))
    times = {name: round(seconds(spark, name, folder), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
