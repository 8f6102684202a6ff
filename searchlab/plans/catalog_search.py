"""Registered queries: lexical, exact, approximate and reduced search, encoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from searchlab.functions.text import PASSAGE_PREFIX
from searchlab.functions.vectors import l2_norm, unit_vector
from searchlab.operators import ann, checks, lexical, reduction
from searchlab.operators.dense import exact_top_k
from searchlab.operators.encode import encode_texts
from searchlab.plans import views, views_sql as v
from searchlab.plans.registry import query, rounded
from searchlab.sources.staging import new_location, stage


def ranked(run: DataFrame, digits: int = 6) -> DataFrame:
    """Ranked list with its score rounded for the comparison, after the ranking."""
    score = F.round("score", digits) + 0.0
    return run.select("query_id", "rank", "doc_id", score.alias("score"))


# --- lexical ----------------------------------------------------------------
def spread_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus in as many parts as there are cores: its table is one file, and so one task."""
    return views.corpus(spark, sf).repartition(spark.sparkContext.defaultParallelism)


def lexical_index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    buckets = lexical.bucket_count(views.corpus(spark, sf))  # the texts need no spreading for their size
    return lexical.write_index(spread_corpus(spark, sf), buckets=buckets)


@query(
    "bm25_postings",
    f"WITH {v.CORPUS}, {v.POSTINGS} SELECT doc_id, term, wtf, tf, doc_len FROM postings",
)
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    postings = lexical.build_postings(spread_corpus(spark, sf))
    return postings.select("doc_id", "term", "wtf", "tf", "doc_len")


@query(
    "bm25_stats",
    f"""WITH {v.CORPUS}, {v.POSTINGS}
        SELECT term, df, documents, round(tokens / documents, 6) AS mean_length
        FROM terms, totals""",
)
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = lexical_index(spark, sf)
    mean_length = index.totals.select(F.round(F.col("tokens") / F.col("documents"), 6)).scalar()
    return index.terms.select(
        "term",
        "df",
        index.totals.select("documents").scalar().alias("documents"),
        mean_length.alias("mean_length"),
    )


@query(
    "bm25_match",
    f"""WITH {v.CORPUS}, {v.QUERIES}, {v.QUERY_TERMS}, {v.POSTINGS}
        SELECT query_id, count(DISTINCT doc_id) AS n_docs
        FROM query_terms JOIN postings USING (term) GROUP BY query_id""",
)
def bm25_match(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.match_counts(lexical_index(spark, sf), views.queries(spark, sf))


@query("bm25_topk", f"WITH {v.BM25_ALL} SELECT query_id, rank, doc_id, score FROM bm25")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.search_bm25(lexical_index(spark, sf), views.queries(spark, sf))
    return ranked(found)


@query("bm25_topk_pruned", f"WITH {v.BM25_ALL} SELECT query_id, rank, doc_id, score FROM bm25")
def bm25_topk_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The form for large indexes: blocks that cannot matter are set aside."""
    found = lexical.search_bm25(lexical_index(spark, sf), views.queries(spark, sf), prune_from=0)
    return ranked(found)


COMMON_SQL = f"""WITH {v.BM25_COMMON},
    whole AS ({v.top_k("SELECT * FROM bm25_scores", digits=12)})
    SELECT query_id, rank, doc_id, score FROM whole"""


@query("bm25_common_terms", COMMON_SQL)
def bm25_common_terms(spark: SparkSession, sf: str) -> DataFrame:
    return common_terms(spark, sf, lexical.PRUNE_FROM)


@query("bm25_common_terms_pruned", COMMON_SQL)
def bm25_common_terms_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return common_terms(spark, sf, 0)


def common_terms(spark: SparkSession, sf: str, prune_from: int) -> DataFrame:
    """The commonest words as queries: all scores lie at the floor of the weights."""
    index = lexical_index(spark, sf)
    words = index.terms.filter(F.col("term").rlike("^[a-z0-9]+$"))
    commonest = words.orderBy(F.col("df").desc(), "term").limit(v.COMMON_TERMS)
    asked = commonest.select(
        F.concat(F.lit("C"), "term").alias("query_id"), F.col("term").alias("query")
    )
    return ranked(lexical.search_bm25(index, stage(asked, "common_terms"), prune_from=prune_from), digits=12)


@query(
    "bm25_run",
    f"""WITH {v.BM25_ALL}
        SELECT query_id, query, category, 'bm25' AS system, rank, doc_id, score,
               title, company, country, level, skills
        FROM bm25 JOIN queries USING (query_id) JOIN corpus USING (doc_id)""",
)
def bm25_run(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked lists with the metadata of query and document."""
    asked = views.queries(spark, sf)
    lexical.require_searchable(asked)
    found = stage(lexical.search_bm25(lexical_index(spark, sf), asked), "bm25_run")
    return with_metadata(
        rounded(found, "score").withColumn("system", F.lit("bm25")),
        asked,
        views.corpus(spark, sf),
        ["title", "company", "country", "level", "skills"],
    ).select(
        "query_id", "query", "category", "system", "rank", "doc_id", "score",
        "title", "company", "country", "level", "skills",
    )


def with_metadata(
    run: DataFrame, asked: DataFrame, corpus: DataFrame, columns: list[str]
) -> DataFrame:
    """Run + document and query columns. The staged run meets the corpus first: its
    known size lets it be broadcast, so the corpus is not shuffled."""
    return corpus.select("doc_id", *columns).join(run, "doc_id").join(asked, "query_id")


# --- vectors ----------------------------------------------------------------
EXACT = ",".join([v.VECTORS, v.LABEL_MEANS, v.VEC_QUERIES, v.RUN_EXACT])
EXACT_SQL = f"WITH {EXACT} SELECT query_id, rank, doc_id, score FROM run_exact"


@query("dense_exact_topk", EXACT_SQL)
def dense_exact(spark: SparkSession, sf: str) -> DataFrame:
    found = views.run_exact(views.embeddings(spark, sf), views.staged_vec_queries(spark, sf))
    return ranked(found)


@query("dense_exact_topk_blocked", EXACT_SQL)
def dense_exact_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """The form for query sets too large to broadcast, with small blocks: four of queries or more."""
    found = exact_top_k(
        views.embeddings(spark, sf),
        views.staged_vec_queries(spark, sf),
        broadcast_bytes=0,
        block_bytes=2**16,
        query_block_bytes=1300,
    )
    return ranked(found)


@query(
    "run_with_metadata",
    f"""WITH {EXACT}
        SELECT query_id, qlabel, category, 'dense_flat' AS system, rank, doc_id, score, label
        FROM run_exact JOIN vec_queries USING (query_id) JOIN vectors USING (doc_id)""",
)
def run_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    run = rounded(stage(views.run_exact(vectors, asked), "run"), "score")
    run = run.withColumn("system", F.lit("dense_flat"))
    return with_metadata(run, asked.drop("qvec"), vectors, ["label"]).select(
        "query_id", "qlabel", "category", "system", "rank", "doc_id", "score", "label"
    )


@query(
    "l2_normalize",
    f"""WITH {v.VECTORS},
        scaled AS (SELECT doc_id, [x * (label + 1) FOR x IN embedding] AS wide FROM vectors),
        units AS (SELECT doc_id, wide, {v.unit("wide")} AS unit FROM scaled)
        SELECT doc_id, round(sqrt(list_inner_product(wide, wide)), 6) AS norm,
               round(sqrt(list_inner_product(unit, unit)), 6) AS unit_norm,
               round(list_sum(unit), 6) + 0.0 AS unit_sum FROM units""",
)
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Whole vectors, scaled by their label first so that their norms differ from 1."""
    scaled = views.embeddings(spark, sf).select(
        "doc_id",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("wide"),
    )
    units = scaled.withColumn("unit", unit_vector(F.col("wide")))
    total = F.aggregate("unit", F.lit(0.0), lambda a, x: a + x)
    measured = units.select(
        "doc_id",
        l2_norm(F.col("wide")).alias("norm"),
        l2_norm(F.col("unit")).alias("unit_norm"),
        total.alias("unit_sum"),
    )
    return rounded(measured, "norm", "unit_norm", "unit_sum").withColumn(
        "unit_sum", F.col("unit_sum") + 0.0
    )


def vector_rules(vectors: str) -> str:
    return f"""SELECT 'null_vector' AS rule, count(*) - count(embedding) AS n FROM {vectors}
       UNION ALL SELECT 'wrong_dimension', count(*) FILTER (len(embedding) <> 64) FROM {vectors}
       UNION ALL SELECT 'not_a_number',
         count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0)
         FROM {vectors}
       UNION ALL SELECT 'wrong_element_type', count(*) FILTER (typeof(embedding) <> 'FLOAT[]') FROM {vectors}
       UNION ALL SELECT 'repeated_id', count(*) FROM (
         SELECT vec_id FROM {vectors} GROUP BY vec_id HAVING count(*) > 1)
       UNION ALL SELECT 'vector_without_document', count(*) FROM {vectors}
         WHERE vec_id NOT IN (SELECT doc_id FROM documents)
       UNION ALL SELECT 'document_without_vector', count(*) FROM documents
         WHERE doc_id NOT IN (SELECT vec_id FROM {vectors})"""


@query("validate_vectors", vector_rules("embeddings"))
def validate_vectors(spark: SparkSession, sf: str) -> DataFrame:
    documents = views.table(spark, sf, "documents").select("doc_id")
    return checks.vector_report(views.embeddings(spark, sf), documents, 64)


@query(
    "validate_faulty_vectors",
    f"""WITH faulty AS (
          SELECT vec_id, CASE WHEN vec_id % 50 = 1 THEN NULL
                   WHEN vec_id % 50 = 2 THEN (embedding::DOUBLE[])[:63]
                   WHEN vec_id % 50 = 3 THEN list_append((embedding::DOUBLE[])[:63], 'nan'::DOUBLE)
                   ELSE embedding::DOUBLE[] END AS embedding
          FROM embeddings
          UNION ALL SELECT vec_id, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 50 = 4)
        {vector_rules("faulty")}""",
)
def validate_faulty_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Whole vectors with planted faults of every kind that one table can have."""
    vectors = views.embeddings(spark, sf).withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind, short = F.col("doc_id") % 50, F.slice("embedding", 1, 63)
    faulty = vectors.withColumn(
        "embedding",
        F.when(kind == 1, F.lit(None)).when(kind == 2, short)
        .when(kind == 3, F.array_append(short, F.lit(float("nan")))).otherwise(F.col("embedding")),
    )
    faulty = faulty.unionAll(vectors.filter(kind == 4))
    return checks.vector_report(faulty, views.table(spark, sf, "documents").select("doc_id"), 64)


def fingerprint_sql(table: str, columns: list[str]) -> str:
    parts = ", ".join(f"coalesce('=' || {c}::VARCHAR, 'null')" for c in columns)
    return (
        f"(SELECT count(*) || ':' || coalesce(sum(('0x' || substr(md5(concat_ws('|', {parts})), 1, "
        f"{checks.HASH_DIGITS}))::BIGINT), 0)::HUGEINT FROM {table})"
    )


FINGERPRINTED = ["doc_id", "text", "lang"]


@query(
    "stale_artefact_report",
    f"""SELECT 'content' AS fact, {fingerprint_sql("documents", FINGERPRINTED)} AS stored,
          {fingerprint_sql("(SELECT doc_id, CASE WHEN doc_id % 100 = 1 THEN '' ELSE text END AS text, lang "
                           "FROM documents)", FINGERPRINTED)} AS expected
        UNION ALL SELECT 'weights', 'title=3', 'title=2'""",
)
def stale_artefact_report(spark: SparkSession, sf: str) -> DataFrame:
    """An artefact made from all documents, asked for again after some texts and a weight changed."""
    documents = views.table(spark, sf, "documents")
    emptied = F.when(F.col("doc_id") % 100 == 1, F.lit("")).otherwise(F.col("text"))
    location = new_location(spark, "artefact")
    checks.write_manifest(
        spark, location, weights="title=3", rows=documents.count(),
        content=checks.content_fingerprint(documents, FINGERPRINTED),
    )
    # Other parts than before, of bounded size: most documents are of one language.
    changed = documents.hint("rebalance", "lang", "doc_id").withColumn("text", emptied)
    return checks.stale_artefact_report(
        spark, location, weights="title=2", rows=changed.count(),
        content=checks.content_fingerprint(changed, FINGERPRINTED),
    )


# --- approximate ------------------------------------------------------------
CELL_BASE = ",".join([v.VECTORS, v.LABEL_MEANS, v.VEC_QUERIES, v.CELLS_SQL])


@query("ivf_assign", f"WITH {CELL_BASE} SELECT doc_id, cell FROM assigned")
def ivf_assign(spark: SparkSession, sf: str) -> DataFrame:
    vectors = views.embeddings(spark, sf)
    return ann.assign_cells(vectors, views.centroids(vectors)).select("doc_id", "cell")


@query(
    "ivf_topk",
    f"WITH {CELL_BASE}, {v.RUN_CELLS} SELECT query_id, rank, doc_id, score FROM run_cells",
)
def ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Search of saved cells: only the folders of visited cells are read."""
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    pivots = views.centroids(vectors)
    found = ann.search_cells(saved_cells(vectors, pivots), asked, pivots, [views.PROBES])
    return ranked(found.drop("nprobe"))


def saved_cells(vectors: DataFrame, pivots: DataFrame) -> DataFrame:
    location = new_location(vectors.sparkSession, "cells")
    ann.write_cells(ann.assign_cells(vectors, pivots), location)
    return ann.read_cells(vectors.sparkSession, location)


@query(
    "ann_recall",
    f"""WITH {CELL_BASE}, {v.RUN_CELLS}, {v.RUN_EXACT}
        SELECT '{v.cells_label()}' AS system,
               round((SELECT count(*) FROM run_cells a JOIN run_exact e USING (query_id, doc_id)
                      WHERE a.rank <= 10 AND e.rank <= 10)
                     / ((SELECT count(*) FROM vec_queries) * 10), 6) AS ann_recall_at_10""",
)
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    exact = stage(views.run_exact(vectors, asked), "exact")
    cells = stage(
        views.run_cells(vectors, asked, views.centroids(vectors)).withColumn(
            "system", F.lit(v.cells_label())
        ),
        "cells",
    )
    recall = ann.recall_against_exact(exact, cells, 10, ["system"])
    return rounded(recall, "ann_recall_at_10")


def nearest_sql(left: str, right: str, key: str, id_col: str) -> str:
    """Place of each ``id_col`` among the products of ``left`` and ``right`` vectors of a ``key``."""
    near = f"list_inner_product({left}, {right})"
    return f"row_number() OVER (PARTITION BY {key} ORDER BY {v.significant(near)} DESC, {id_col})"


FIRST_CELLS, SEARCHED_CELLS = (part.strip().rstrip(",") for part in v.CELLS_SQL.split("assigned AS", 1))


def moved_sql(before: str, after: str) -> str:
    """CTE ``after``: unit means of the cells of ``before``."""
    return f"""
        {after}_cells AS (
          SELECT embedding, cell FROM vectors, {before}
          QUALIFY {nearest_sql("embedding", "centroid", "doc_id", "cell")} = 1),
        {after}_means AS (
          SELECT cell, list(x ORDER BY i) AS mean FROM (
            SELECT cell, i, avg(x) AS x FROM (
              SELECT cell, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {after}_cells)
            GROUP BY cell, i) GROUP BY cell),
        {after} AS (
          SELECT cell, CASE WHEN mean IS NULL THEN centroid ELSE {v.unit("mean")} END AS centroid
          FROM {before} LEFT JOIN {after}_means USING (cell))"""


LEAVES, GROUPS = 64, 8


@query(
    "cell_tree_topk",
    f"""WITH {v.VECTORS}, {v.LABEL_MEANS}, {v.VEC_QUERIES},
        leaves AS (SELECT doc_id AS cell, embedding AS centroid FROM vectors
                   ORDER BY {v.hashed("doc_id")} LIMIT {LEAVES}),
        heads AS (SELECT cell AS top, centroid AS head FROM leaves
                  ORDER BY {v.hashed("cell")} LIMIT {GROUPS}),
        grouped AS (SELECT cell, centroid, top FROM leaves, heads
                    QUALIFY {nearest_sql("centroid", "head", "cell", "top")} = 1),
        asked AS (SELECT 'd' || doc_id AS key, embedding AS vec FROM vectors
                  UNION ALL SELECT 'q' || query_id, qvec FROM vec_queries),
        beams AS (SELECT key, vec, top FROM asked, (SELECT * FROM heads WHERE top IN (SELECT top FROM grouped))
                  QUALIFY {nearest_sql("vec", "head", "key", "top")} <= {ann.BEAM}),
        visits AS (SELECT key, cell, {nearest_sql("vec", "centroid", "key", "cell")} AS visit
                   FROM beams JOIN grouped USING (top)),
        run_tree AS ({v.top_k(f"""
          SELECT query_id, doc_id, list_inner_product(qvec, embedding) AS score
          FROM vec_queries JOIN visits a ON a.key = 'q' || query_id AND a.visit <= {views.PROBES}
          JOIN visits b ON b.cell = a.cell AND b.visit = 1 JOIN vectors ON b.key = 'd' || doc_id""")})
        SELECT query_id, rank, doc_id, score FROM run_tree""",
)
def cell_tree_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Saved cells whose centroids lie in groups: neither vectors nor queries meet all centroids."""
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    centroids = stage(ann.pivot_centroids(vectors, LEAVES), "centroids")
    tops, leaves = ann.cell_tree(centroids, GROUPS)
    location = new_location(spark, "cells")
    ann.write_cells(ann.assign_tree_cells(vectors, tops, leaves), location)
    saved = ann.read_cells(spark, location)
    return ranked(ann.search_cell_tree(saved, asked, tops, leaves, [views.PROBES]).drop("nprobe"))


@query(
    "ivf_refined_topk",
    f"""WITH {v.VECTORS}, {v.LABEL_MEANS}, {v.VEC_QUERIES},
        {FIRST_CELLS.replace("centroids AS", "round0 AS", 1)},
        {moved_sql("round0", "round1")}, {moved_sql("round1", "centroids")},
        assigned AS {SEARCHED_CELLS}, {v.RUN_CELLS}
        SELECT query_id, rank, doc_id, score FROM run_cells""",
)
def ivf_refined_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted cells: sampled centroids moved twice to the mean of their cells, then saved and searched."""
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    centers = ann.refined_centroids(vectors, views.centroids(vectors), 2)
    found = ann.search_cells(saved_cells(vectors, centers), asked, centers, [views.PROBES])
    return ranked(found.drop("nprobe"))


SWEEP = [1, 2, 4, 8, 16]


@query(
    "ann_sweep",
    f"""WITH {CELL_BASE}, {v.RUN_EXACT},
        settings AS (SELECT unnest({SWEEP}) AS nprobe),
        found AS (
          SELECT *, row_number() OVER (
                   PARTITION BY query_id, nprobe ORDER BY {v.significant("score")} DESC, doc_id)
                     AS rank
          FROM (SELECT query_id, nprobe, doc_id, list_inner_product(qvec, embedding) AS score
                FROM settings JOIN routes ON visit <= nprobe JOIN assigned USING (cell)))
        SELECT nprobe::BIGINT AS nprobe,
               round(count(e.doc_id) / ((SELECT count(*) FROM vec_queries) * 10), 6)
                 AS ann_recall_at_10
        FROM found a LEFT JOIN run_exact e
          ON a.query_id = e.query_id AND a.doc_id = e.doc_id AND a.rank <= 10 AND e.rank <= 10
        GROUP BY nprobe""",
)
def ann_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Recall for every number of visited cells, from one search job."""
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    pivots = views.centroids(vectors)
    exact = stage(views.run_exact(vectors, asked), "exact")
    found = stage(
        ann.search_cells(saved_cells(vectors, pivots), asked, pivots, SWEEP), "sweep"
    )
    return rounded(ann.recall_against_exact(exact, found), "ann_recall_at_10")


@query("ivf_kmeans_topk")
def ivf_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    centers = stage(ann.kmeans_centroids(vectors, views.CELLS), "kmeans")
    run = views.run_cells(vectors, asked, centers)
    return ranked(run)


@query("ivf_kmeans_all_cells", EXACT_SQL)
def ivf_kmeans_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell is visited: whatever the fitted centroids, this is the exact search."""
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    centers = stage(ann.kmeans_centroids(vectors, views.CELLS), "kmeans")
    assigned = ann.assign_cells(vectors, centers)
    return ranked(ann.search_cells(assigned, asked, centers, [views.CELLS]))


AXES = 4
WIDTH = 0.125  # 1 / sqrt(64)


@query(
    "lsh_topk",
    f"""WITH {v.VECTORS}, {v.LABEL_MEANS}, {v.VEC_QUERIES},
        axes AS (SELECT doc_id AS axis, embedding AS direction FROM vectors
                 ORDER BY {v.hashed("doc_id")} LIMIT {AXES}),
        doc_codes AS (SELECT doc_id, embedding, axis,
                 floor((round(list_inner_product(embedding, direction), 6) + 0.0) / {WIDTH}) AS code
               FROM vectors, axes),
        query_codes AS (SELECT query_id, qvec, axis,
                 floor((round(list_inner_product(qvec, direction), 6) + 0.0) / {WIDTH}) AS code
               FROM vec_queries, axes)
        SELECT query_id, rank, doc_id, score FROM ({v.top_k('''
          SELECT DISTINCT query_id, doc_id, list_inner_product(qvec, embedding) AS score
          FROM query_codes JOIN doc_codes USING (axis, code)''')})""",
)
def lsh_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors, asked = views.embeddings(spark, sf), views.staged_vec_queries(spark, sf)
    axes = stage(ann.pivot_centroids(vectors, AXES), "axes")
    buckets = ann.assign_projection_buckets(vectors, axes, WIDTH)
    found = ann.search_projection_buckets(buckets, asked, axes, WIDTH)
    return ranked(found)


# --- reduction --------------------------------------------------------------
def label_basis(spark: SparkSession, sf: str) -> reduction.Projection:
    return views.label_basis(views.embeddings(spark, sf), views.staged_vec_queries(spark, sf))


@query(
    "project_vectors",
    f"""WITH {v.VECTORS}, {v.LABEL_MEANS}, {v.VEC_QUERIES}, {v.BASIS},
        reduced AS (SELECT doc_id, {v.reduced("embedding")} AS small FROM vectors, center, basis)
        SELECT doc_id, len(small) AS dimension, round(small[1], 6) + 0.0 AS first,
               round(small[{views.REDUCED}], 6) + 0.0 AS last,
               round(list_sum(small), 6) + 0.0 AS total FROM reduced""",
)
def project_vectors(spark: SparkSession, sf: str) -> DataFrame:
    small = reduction.project(
        views.embeddings(spark, sf).select("doc_id", "embedding"), label_basis(spark, sf), views.REDUCED
    )
    parts = {
        "first": F.col("embedding")[0],
        "last": F.col("embedding")[views.REDUCED - 1],
        "total": F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x),
    }
    return small.select(
        "doc_id",
        F.size("embedding").cast("long").alias("dimension"),
        *[(F.round(c, 6) + 0.0).alias(name) for name, c in parts.items()],
    )


@query(
    "project_dimensions",
    f"""WITH {v.VECTORS}, {v.LABEL_MEANS}, {v.VEC_QUERIES}, {v.BASIS},
        wide AS (SELECT doc_id, {v.reduced("embedding")} AS whole FROM vectors, center, basis),
        cut AS (SELECT doc_id, dim, {v.unit("part")} AS small
                FROM (SELECT doc_id, dim, whole[1:dim] AS part
                      FROM wide, (SELECT unnest([2, 4, {views.REDUCED}]) AS dim)))
        SELECT doc_id, dim, round(small[1], 6) + 0.0 AS first,
               round(list_sum(small), 6) + 0.0 AS total FROM cut""",
)
def project_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = views.embeddings(spark, sf).select("doc_id", "embedding")
    small = reduction.project_dimensions(vectors, label_basis(spark, sf), [2, 4, views.REDUCED])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return small.select(
        "doc_id",
        "dim",
        (F.round(F.col("embedding")[0], 6) + 0.0).alias("first"),
        (F.round(total, 6) + 0.0).alias("total"),
    )


@query(
    "dense_reduced_topk",
    f"""WITH {v.VECTORS}, {v.LABEL_MEANS}, {v.VEC_QUERIES}, {v.RUN_REDUCED}
        SELECT query_id, rank, doc_id, score FROM run_reduced""",
)
def dense_reduced(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(
        views.run_reduced(views.embeddings(spark, sf), views.staged_vec_queries(spark, sf))
    )


def reduced_search(
    spark: SparkSession, sf: str, basis: reduction.Projection, dimension: int, asked: DataFrame
) -> DataFrame:
    vectors = views.embeddings(spark, sf).select("doc_id", "embedding")
    found = exact_top_k(
        reduction.project(vectors, basis, dimension),
        stage(reduction.project(asked, basis, dimension, "qvec"), "reduced_queries"),
    )
    return ranked(found)


@query("dense_pca_topk")
def dense_pca(spark: SparkSession, sf: str) -> DataFrame:
    basis, _ = reduction.fit_pca(views.embeddings(spark, sf), 32)
    return reduced_search(
        spark, sf, basis, 16, views.vec_queries(spark, sf).select("query_id", "qvec")
    )


@query("pca_fit")
def pca_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the fitted model, one row per component and axis."""
    basis, rows = reduction.fit_pca(views.embeddings(spark, sf), 32)
    components = [(i, row.tolist()) for i, row in enumerate(basis.components, start=1)]
    return spark.createDataFrame(components, "component int, vector array<double>").select(
        "component", F.lit(rows).alias("sample_size"), F.posexplode("vector").alias("axis", "value")
    )


@query("explained_variance")
def explained_variance(spark: SparkSession, sf: str) -> DataFrame:
    basis, _ = reduction.fit_pca(views.embeddings(spark, sf), 32)
    return reduction.explained_variance(spark, basis)


@query(
    "pca_facts",
    f"""WITH {v.VECTORS},
        parts AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vectors),
        spread AS (SELECT round(sum(s), 6) AS total FROM (SELECT var_samp(x) AS s FROM parts GROUP BY i))
        SELECT 'vectors' AS fact, count(*)::DOUBLE AS value FROM vectors
        UNION ALL SELECT 'total_variance', total FROM spread
        UNION ALL SELECT unnest(['not_orthonormal', 'not_eigenvectors', 'wrong_shares',
                                 'wrong_running_sum', 'not_falling', 'missing_share']), 0.0""",
)
def pca_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for the components whatever their signs, against sums of their own."""
    vectors = views.embeddings(spark, sf)
    spread, rows = reduction.covariance(vectors)
    width = len(spread)
    basis, _ = reduction.fit_pca(vectors, width - 1)
    components, shares = basis.components, basis.ratios
    values = np.einsum("ij,jk,ik->i", components, spread, components)
    running = reduction.explained_variance(spark, basis).orderBy("component").collect()
    upto = np.array([r["cumulative_explained_variance_ratio"] for r in running])
    # The one component that is not fitted holds what remains of the variance.
    last = np.linalg.eigvalsh(spread)[0] / np.trace(spread)
    facts = {
        "vectors": float(rows),
        "total_variance": np.trace(spread),
        "not_orthonormal": np.abs(components @ components.T - np.eye(width - 1)).max(),
        "not_eigenvectors": np.abs(components @ spread - values[:, None] * components).max(),
        "wrong_shares": np.abs(shares - values / np.trace(spread)).max(),
        "wrong_running_sum": np.abs(upto - np.cumsum(shares)).max(),
        "not_falling": max(0.0, np.diff(shares).max()),
        "missing_share": abs(1.0 - upto[-1] - last),
    }
    table = [(fact, round(float(value), 6) + 0.0) for fact, value in facts.items()]
    return spark.createDataFrame(table, "fact string, value double")


DIMENSIONS = [8, 16, 32]


@query(
    "reduction_report",
    f"""SELECT count(*) AS documents, max(len(embedding)) AS input_dimension,
               d::BIGINT AS output_dimension, max(len(embedding)) * 4 AS input_bytes_per_vector,
               d::BIGINT * 4 AS output_bytes_per_vector,
               round(max(len(embedding)) / d, 6) AS compression_ratio
        FROM embeddings, (SELECT unnest({DIMENSIONS}) AS d) GROUP BY d""",
)
def reduction_report(spark: SparkSession, sf: str) -> DataFrame:
    report = reduction.reduction_report(views.embeddings(spark, sf), DIMENSIONS)
    return rounded(report, "compression_ratio")


@query("reduction_report_with_variance")
def reduction_report_with_variance(spark: SparkSession, sf: str) -> DataFrame:
    vectors = views.embeddings(spark, sf)
    basis, _ = reduction.fit_pca(vectors, max(DIMENSIONS))
    return reduction.reduction_report(vectors, DIMENSIONS, projection=basis)


# --- encoding ---------------------------------------------------------------
@query(
    "encode_texts",
    f"""WITH {v.encoded("codes", "documents", "doc_id", "text", PASSAGE_PREFIX)}
        SELECT doc_id, bucket, round(weight, 6) AS weight FROM codes
        WHERE round(weight, 6) <> 0""",
)
def encoded_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = views.table(spark, sf, "documents")
    vectors = encode_texts(documents, ["doc_id"], F.col("text"), PASSAGE_PREFIX)
    weights = vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return (
        weights.withColumn("bucket", F.col("bucket").cast("long"))
        .withColumn("weight", F.round("weight", 6))
        .filter(F.col("weight") != 0)
    )
