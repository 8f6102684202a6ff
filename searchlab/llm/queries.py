"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from searchlab.llm.best_fit import best_fit
from searchlab.llm.common import table
from searchlab.llm.count_tree import jaccard_components
from searchlab.llm.edit_match import benchmark_matches
from searchlab.llm.hard_negatives import hard_negatives
from searchlab.llm.html_text import extract_pages
from searchlab.llm.language import predict_languages, train_network
from searchlab.llm.minhash import near_duplicates
from searchlab.llm.packed_ids import packed_matrix
from searchlab.llm.personal_data import find_personal_data
from searchlab.llm.quality import quality_scores
from searchlab.llm.radix_dedup import exact_groups
from searchlab.llm.token_alignment import aligned_tokens
from searchlab.llm.token_trees import apply_edits, build_trees, revision
from searchlab.llm.tokens import token_pieces
from searchlab.sources.staging import stage

SEQUENCE = 1024


def op1_packed_id_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrix(table(spark, sf_dir, "documents"), seq_len=2048)


def op2_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""


def op3_benchmark_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_personal_data_labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, train_network(docs))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), SEQUENCE, keep_ids=False)
    return best_fit(pieces, ["doc_id", "piece"], SEQUENCE).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op8_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = stage(build_trees(table(spark, sf_dir, "documents")), "token_trees")
    return apply_edits(trees, revision())


def op9_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op11_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        list_dot_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
    (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def jaccard_sql(words: int, percent: int, columns: str) -> str:
    """Word shingle sets, all pairs that share a shingle, and the closure of the links."""
    return f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
        range(1, greatest(len(w) - {words - 1}, 1) + 1),
        lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS g
    FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
t AS (SELECT doc_id, unnest(g) AS shingle FROM g),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
    SELECT doc_id AS node, doc_id AS low FROM n
    UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT {columns} FROM n JOIN c ON c.node = n.doc_id
"""


OP10_SQL = jaccard_sql(2, 80, "doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept")
OP12_SQL = jaccard_sql(3, 90, "doc_id, n AS n_shingles, component_id")


def op13_galloping_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packed_id_matrix": op1_packed_id_matrix,
    "op2_radix_dedup": op2_radix_dedup,
    "op3_benchmark_edit_match": op3_benchmark_edit_match,
    "op4_quality_discriminant": op4_quality_discriminant,
    "op5_personal_data_labelers": op5_personal_data_labelers,
    "op6_byte_network_language": op6_byte_network_language,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_edit_aware_token_counts": op8_edit_aware_token_counts,
    "op9_line_block_text": op9_line_block_text,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_strassen_hard_negatives": op11_strassen_hard_negatives,
    "op12_count_tree_join": op12_count_tree_join,
    "op13_galloping_token_alignment": op13_galloping_token_alignment,
}
CHECK_SQL = {
    "op2_radix_dedup": OP2_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op11_strassen_hard_negatives": OP11_SQL,
    "op12_count_tree_join": OP12_SQL,
}
