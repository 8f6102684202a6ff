"""The views of ``views`` as SQL text for the check queries."""

from __future__ import annotations

from searchlab.functions.text import DOCUMENT_TOKEN_PATTERN
from searchlab.operators.encode import DIMENSION
from searchlab.operators.sampling import RARE_LIMIT, SEED
from searchlab.operators.topk import SCORE_DIGITS
from searchlab.plans.views import CELLS, POOL_DEPTH, POOL_LIMIT, PROBES, REDUCED, cells_label

# Unicode white space written out: \s is ASCII-only in this engine.
SPACE_CLASS = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


# Single diacritics composed by this engine; a map of its own, not that of ``functions.text``.
COMPOSED = """
  (SELECT b, m, nfc_normalize(b || m) AS c
   FROM (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS b),
        (SELECT chr(unnest(range(768, 880))::INTEGER) AS m)
   WHERE length(nfc_normalize(b || m)) = 1 AND nfc_normalize(m) = m)"""
VARIANTS, COMMON_FORMS = "ςµſẛϐϑϕϖϰϱϵ", "σμssβθφπκρε"


def tokens(text: str) -> str:
    folding = f"(SELECT string_agg(c, '' ORDER BY c) FROM {COMPOSED})"
    plain = f"(SELECT string_agg(b, '' ORDER BY c) FROM {COMPOSED})"
    marks = f"(SELECT string_agg(DISTINCT m, '') FROM {COMPOSED})"
    return (
        f"regexp_extract_all(translate(lower({text}), '{VARIANTS}' || {folding} || {marks}, "
        f"'{COMMON_FORMS}' || {plain}), '{DOCUMENT_TOKEN_PATTERN}')"
    )


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{SPACE_CLASS}]+'))::BIGINT"


def cleaned(text: str) -> str:
    """Entities that occur in the tables (the semicolon may be missing), the
    ampersand last; then tags, control characters, space."""
    plain = f"coalesce({text}, '')"
    for entity, char in [("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")]:
        plain = f"regexp_replace({plain}, '&{entity};?', '{char}', 'g')"
    plain = f"regexp_replace({plain}, '<[^>]+>', ' ', 'g')"
    plain = rf"regexp_replace({plain}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')"
    return f"trim(regexp_replace({plain}, '[{SPACE_CLASS}]+', ' ', 'g'))"


def hashed(key: str) -> str:
    return f"md5('{SEED}|' || {key})"


def unit(vector: str) -> str:
    norm = f"sqrt(list_inner_product({vector}, {vector}))"
    return f"[x / (CASE WHEN {norm} = 0 THEN 1 ELSE {norm} END) FOR x IN {vector}]"


def significant(score: str) -> str:
    """The key by which scores are compared: twelve significant digits."""
    size = f"greatest(abs({score}), 1e-100)"
    scale = f"pow(10, {SCORE_DIGITS - 1} - floor(log10({size})))"
    return f"CASE WHEN abs({score}) < 1e-100 THEN 0 ELSE round({score} * {scale}) / {scale} END"


def top_k(
    scored: str, doc: str = "doc_id", k: int = 20, score: str = "score", digits: int = 6
) -> str:
    """Ranks by the whole score; it is rounded afterwards, for the comparison only."""
    return (
        f"SELECT * REPLACE (round({score}, {digits}) + 0.0 AS {score}) FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY {significant(score)} DESC, {doc}) AS rank "
        f"FROM ({scored}) QUALIFY rank <= {k})"
    )


CORPUS = """
corpus AS (
  SELECT d.doc_id, lines[1] AS title, coalesce(lines[2], '') AS skills,
         coalesce(array_to_string(lines[3:], ' '), '') AS summary,
         lang AS country, source AS company, coalesce('q' || quality, 'unknown') AS level
  FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents) d
  LEFT JOIN labels USING (doc_id))"""

QUERIES = """
queries AS (
  SELECT 'Q' || item_id AS query_id, text AS query, 'cat' || (item_id % 5) AS category
  FROM benchmark)"""

QUERY_TERMS = """
query_terms AS (
  SELECT query_id, lower(token) AS term, count(*) AS occurrences
  FROM (SELECT query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9]+')) AS token FROM queries)
  GROUP BY ALL)"""

POSTINGS = f"""
field_tokens AS (
  SELECT doc_id, unnest({tokens("title")}) AS term, 3.0::DOUBLE AS weight FROM corpus
  UNION ALL SELECT doc_id, unnest({tokens("skills")}), 2.0 FROM corpus
  UNION ALL SELECT doc_id, unnest({tokens("summary")}), 1.0 FROM corpus),
doc_lengths AS (SELECT doc_id, count(*) AS doc_len FROM field_tokens GROUP BY doc_id),
postings AS (
  SELECT doc_id, doc_len, term, sum(weight) AS wtf, count(*) AS tf
  FROM field_tokens JOIN doc_lengths USING (doc_id) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
totals AS (
  SELECT (SELECT count(*) FROM corpus) AS documents, sum(tf)::BIGINT AS tokens FROM postings)"""

BM25 = f"""
weights AS (
  SELECT query_id, term,
         occurrences * CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END AS weight
  FROM (SELECT *, ln((documents - df + 0.5) / (df + 0.5)) AS idf
        FROM query_terms JOIN terms USING (term), totals)),
bm25_scores AS (
  SELECT query_id, doc_id,
         sum(weight * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * doc_len * documents / tokens)))
           AS score
  FROM weights JOIN postings USING (term), totals GROUP BY ALL),
bm25 AS ({top_k("SELECT * FROM bm25_scores")})"""

BM25_ALL = ",".join([CORPUS, QUERIES, QUERY_TERMS, POSTINGS, BM25])

# The commonest plain words of the corpus as queries, alone.
COMMON_TERMS = 3
COMMON_QUERIES = f"""
queries AS (
  SELECT 'C' || term AS query_id, term AS query FROM terms
  WHERE regexp_full_match(term, '[a-z0-9]+') ORDER BY df DESC, term LIMIT {COMMON_TERMS})"""
BM25_COMMON = ",".join([CORPUS, POSTINGS, COMMON_QUERIES, QUERY_TERMS, BM25])

VECTORS = """
vectors AS (
  SELECT vec_id AS doc_id, embedding::DOUBLE[] AS embedding, label FROM embeddings)"""

LABEL_MEANS = """
label_means AS (
  SELECT label, list(component ORDER BY i) AS mean
  FROM (SELECT label, i, avg(x) AS component
        FROM (SELECT label, unnest(embedding) AS x,
                     generate_subscripts(embedding, 1) AS i FROM vectors)
        GROUP BY label, i)
  GROUP BY label)"""

VEC_QUERIES = f"""
vec_queries AS (
  SELECT 'V' || label AS query_id, {unit("mean")} AS qvec, label AS qlabel,
         'cat' || (label % 4) AS category
  FROM label_means)"""

RUN_EXACT = f"""
run_exact AS ({top_k('''
  SELECT query_id, doc_id, list_inner_product(qvec, embedding) AS score
  FROM vec_queries, vectors''')})"""

BASIS = f"""
center AS (
  SELECT list(component ORDER BY i) AS mean
  FROM (SELECT i, avg(x) AS component
        FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vectors)
        GROUP BY i)),
basis AS (SELECT list(qvec ORDER BY qlabel)[1:{REDUCED}] AS axes FROM vec_queries)"""


def reduced(vector: str) -> str:
    centred = f"[p[1] - p[2] FOR p IN list_zip({vector}, mean)]"
    return unit(f"[list_inner_product({centred}, axis) FOR axis IN axes]")


RUN_REDUCED = f"""{BASIS},
small_docs AS (SELECT doc_id, {reduced("embedding")} AS sv FROM vectors, center, basis),
small_asked AS (SELECT query_id, {reduced("qvec")} AS sq FROM vec_queries, center, basis),
run_reduced AS ({top_k('''
  SELECT query_id, doc_id, list_inner_product(sq, sv) AS score
  FROM small_asked, small_docs''')})"""

CELLS_SQL = f"""
centroids AS (
  SELECT doc_id AS cell, embedding AS centroid FROM vectors
  ORDER BY {hashed("doc_id")} LIMIT {CELLS}),
assigned AS (
  SELECT doc_id, embedding, cell FROM (
    SELECT doc_id, embedding, cell,
           row_number() OVER (PARTITION BY doc_id ORDER BY {significant("near")} DESC, cell) AS place
    FROM (SELECT *, list_inner_product(embedding, centroid) AS near FROM vectors, centroids))
  WHERE place = 1),
routes AS (
  SELECT query_id, qvec, cell,
         row_number() OVER (PARTITION BY query_id ORDER BY {significant("near")} DESC, cell) AS visit
  FROM (SELECT *, list_inner_product(qvec, centroid) AS near FROM vec_queries, centroids))"""

RUN_CELLS = f"""
run_cells AS ({top_k(f'''
  SELECT query_id, doc_id, list_inner_product(qvec, embedding) AS score
  FROM routes JOIN assigned USING (cell) WHERE visit <= {PROBES}''')})"""

VECTOR_RUNS = (
    ",".join([VECTORS, LABEL_MEANS, VEC_QUERIES, RUN_EXACT, RUN_REDUCED, CELLS_SQL, RUN_CELLS])
    + f""",
runs AS (
  SELECT r.*, qlabel, category, 'label ' || qlabel AS query,
         1.0::DOUBLE + (qlabel * 7) % 11 + CASE system WHEN 'dense_flat' THEN 2.0
           WHEN '{cells_label()}' THEN 0.0 ELSE 1.0 END AS latency_ms
  FROM (SELECT *, 'dense_flat' AS system FROM run_exact
        UNION ALL SELECT *, 'dense_reduced{REDUCED}' FROM run_reduced
        UNION ALL SELECT *, '{cells_label()}' FROM run_cells) r
  JOIN vec_queries USING (query_id))"""
)


def pool(runs: str, depth: int, limit: int) -> str:
    return f"""
      SELECT * FROM (
        SELECT query_id, doc_id, min(query) AS query, min(category) AS category,
               string_agg(DISTINCT system, ', ' ORDER BY system) AS source_systems,
               count(DISTINCT system) AS system_count, min(rank) AS best_rank
        FROM {runs} WHERE rank <= {depth} GROUP BY query_id, doc_id)
      QUALIFY row_number() OVER (PARTITION BY query_id
                ORDER BY system_count DESC, best_rank, doc_id) <= {limit}"""


QRELS = f"""
judged_pool AS ({pool(f"(SELECT * FROM runs WHERE system <> '{cells_label()}')", POOL_DEPTH, POOL_LIMIT)}),
qrels AS (
  SELECT query_id, doc_id, query, p.category,
         greatest(0, 3 - abs(qlabel - label))::DOUBLE AS relevance
  FROM judged_pool p JOIN vectors USING (doc_id) JOIN vec_queries USING (query_id))"""

RAW_JUDGEMENTS = f"""
raw_judgements AS (
  SELECT query_id, doc_id,
         CASE WHEN system = 'dense_flat' AND label = 3 THEN ''
              WHEN system = 'dense_flat' AND label = 5 THEN 'x'
              WHEN system = 'dense_flat' AND label = 7 THEN '5'
              WHEN system <> 'dense_flat' AND label = 8
                THEN greatest(0, 2 - abs(qlabel - label))::VARCHAR
              ELSE greatest(0, 3 - abs(qlabel - label))::VARCHAR END AS relevance
  FROM runs JOIN vectors USING (doc_id) WHERE system <> '{cells_label()}')"""

FAULTY_RUN = """
faulty_run AS (
  SELECT query_id, CASE WHEN qlabel = 7 THEN 0 ELSE doc_id END AS doc_id,
         CASE qlabel WHEN 3 THEN rank - 1 WHEN 5 THEN least(rank, 19) ELSE rank END AS rank, score
  FROM runs WHERE system = 'dense_flat')"""


def metrics(k: int = 10, threshold: float = 2.0) -> str:
    """CTEs ``top_rows, ideal, judged, per_query`` over ``runs`` and ``qrels``."""
    return f"""
top_rows AS (
  SELECT r.system, r.query_id, r.position, relevance, coalesce(relevance, 0) AS grade
  FROM (SELECT *, row_number() OVER (PARTITION BY system, query_id ORDER BY rank) AS position
        FROM runs) r
  LEFT JOIN qrels USING (query_id, doc_id) WHERE position <= {k}),
found AS (
  SELECT system, query_id, count(*) AS retrieved, count(relevance) AS judged,
         count(*) FILTER (grade >= {threshold}) AS hits,
         min(position) FILTER (grade >= {threshold}) AS first_hit,
         sum((pow(2, grade) - 1) / log2(position + 1)) AS dcg
  FROM top_rows GROUP BY ALL),
ideal AS (
  SELECT query_id, sum((pow(2, relevance) - 1) / log2(place + 1)) AS ideal_dcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS place
        FROM qrels) WHERE place <= {k} GROUP BY query_id),
judged_queries AS (
  SELECT query_id, count(*) AS judged_documents,
         count(*) FILTER (relevance >= {threshold}) AS relevant_judged_documents,
         min(query) AS query, min(category) AS category
  FROM qrels GROUP BY query_id),
latencies AS (
  SELECT system, query_id, arg_min(latency_ms, rank) AS latency_ms FROM runs GROUP BY ALL),
per_query AS (
  SELECT s.system, j.query_id, coalesce(retrieved, 0) AS retrieved_at_{k},
         coalesce(judged, 0) AS judged_at_{k},
         CASE WHEN retrieved > 0 THEN judged / retrieved ELSE 0 END AS judgement_coverage_at_{k},
         judged_documents, relevant_judged_documents,
         CASE WHEN ideal_dcg > 0 THEN coalesce(dcg, 0) / ideal_dcg ELSE 0 END AS ndcg_at_{k},
         coalesce(1.0 / first_hit, 0) AS mrr_at_{k},
         coalesce(hits, 0) / {k}.0 AS precision_at_{k},
         CASE WHEN relevant_judged_documents > 0
              THEN coalesce(hits, 0) / relevant_judged_documents ELSE 0 END AS recall_at_{k},
         query, category, latency_ms
  FROM judged_queries j JOIN ideal USING (query_id)
  CROSS JOIN (SELECT DISTINCT system FROM runs) s
  LEFT JOIN found f ON f.system = s.system AND f.query_id = j.query_id
  LEFT JOIN latencies l ON l.system = s.system AND l.query_id = j.query_id)"""


EVALUATION = ",".join([VECTOR_RUNS, QRELS, metrics()])


def strata(key: str, stratum: str, source: str) -> str:
    """CTEs ``keyed(key, stratum), counts, labels, sizes``."""
    return f"""
keyed AS (SELECT {key} AS key, {stratum} AS stratum FROM {source}),
counts AS (SELECT stratum, count(*) AS size FROM keyed GROUP BY stratum),
labels_of AS (
  SELECT stratum, size, CASE WHEN size < {RARE_LIMIT} THEN 'rare' ELSE stratum END AS merged
  FROM counts),
sizes AS (SELECT merged AS stratum, sum(size)::BIGINT AS size FROM labels_of GROUP BY merged)"""


def allocation(sample_size: str) -> str:
    """CTE ``allocation(stratum, size, n)`` over ``sizes``."""
    return f"""
started AS (
  SELECT stratum, size, sample_size,
         least(greatest(round_even(size / total * sample_size, 0)::BIGINT, 1), size) AS start
  FROM sizes, (SELECT sum(size) AS total, {sample_size} AS sample_size FROM sizes)),
gaps AS (SELECT *, (sample_size - sum(start) OVER ())::BIGINT AS gap FROM started),
units AS (
  SELECT stratum, gap,
         row_number() OVER (ORDER BY turn, CASE WHEN gap > 0 THEN size ELSE -size END, stratum)
           AS place
  FROM (SELECT *, unnest(generate_series(1, least(
          CASE WHEN gap > 0 THEN size - start ELSE start - 1 END, abs(gap)))) AS turn FROM gaps)),
corrections AS (
  SELECT stratum, sum(sign(gap))::BIGINT AS correction FROM units WHERE place <= abs(gap)
  GROUP BY stratum),
allocation AS (
  SELECT stratum, size, start + coalesce(correction, 0) AS n
  FROM gaps LEFT JOIN corrections USING (stratum))"""


CUSTOMERS = f"""
customers AS (
  SELECT c_custkey, n_name, c_mktsegment, r_name FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def group_value(text: str) -> str:
    return f"coalesce(nullif(lower({cleaned(text)}), ''), 'unknown')"


CUSTOMER_STRATUM = " || ' | ' || ".join(
    group_value(c) for c in ("n_name", "c_mktsegment", "r_name")
)
CUSTOMER_STRATA = ",".join([CUSTOMERS, strata("c_custkey", CUSTOMER_STRATUM, "customers")])


def encoded(name: str, source: str, key: str, text: str, prefix: str) -> str:
    """CTE ``name(key, bucket, weight)``: unit-length hashed bag of words."""
    return f"""
{name}_words AS (
  SELECT {key}, word, 1 + ln(count(*)) AS weight
  FROM (SELECT {key}, unnest(regexp_extract_all(lower('{prefix}' || {text}), '[\\p{{L}}\\p{{N}}]+'))
          AS word FROM {source})
  GROUP BY ALL),
{name}_sums AS (
  SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {DIMENSION} AS bucket,
         sum(CASE WHEN substr(md5(word), 32, 1) < '8' THEN weight ELSE -weight END) AS weight
  FROM {name}_words GROUP BY ALL),
{name} AS (
  SELECT {key}, bucket, weight / norm AS weight
  FROM {name}_sums JOIN (SELECT {key}, sqrt(sum(weight * weight)) AS norm FROM {name}_sums
                         GROUP BY {key}) USING ({key}) WHERE norm > 0)"""


def dense_from_buckets(docs: str, asked: str) -> str:
    """Inner products of two encoded CTEs; every pair gets a row."""
    return f"""
      SELECT query_id, doc_id, coalesce(score, 0) AS score
      FROM (SELECT DISTINCT query_id FROM {asked})
      CROSS JOIN (SELECT DISTINCT doc_id FROM {docs})
      LEFT JOIN (SELECT a.query_id, d.doc_id, sum(a.weight * d.weight) AS score
                 FROM {asked} a JOIN {docs} d USING (bucket) GROUP BY ALL)
      USING (query_id, doc_id)"""
