"""Cleaning pipeline of a training corpus: each stage reads what the one before kept.

A stage takes (spark, docs, sf_dir) and returns documents with the columns it got; the last
one returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from searchlab.llm.best_fit import best_fit
from searchlab.llm.common import table
from searchlab.llm.edit_match import drop_contaminated
from searchlab.llm.minhash import keep_one_of_each
from searchlab.llm.quality import keep_good
from searchlab.llm.queries import SEQUENCE
from searchlab.llm.radix_dedup import keep_largest
from searchlab.llm.tokens import token_pieces
from searchlab.sources.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of at least 0.3)."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return keep_largest(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the one with the smallest doc_id."""
    return keep_one_of_each(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its error budget."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their place in packed sequences."""
    pieces = token_pieces(docs, SEQUENCE, keep_ids=False)
    return best_fit(pieces, ["doc_id", "piece"], SEQUENCE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Classifier scores, minimal hashes, edit distances and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, f"pipeline_{name}")
    return docs
