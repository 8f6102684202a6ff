"""Registered queries: scans, cleaning, strata, samples, corpus build, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from searchlab.functions.text import (
    clean_text,
    document_tokens,
    query_tokens,
    search_text,
    stratum_key,
    word_count,
)
from searchlab.operators import checks, profile
from searchlab.operators.dedup import distinct_rows, keep_first
from searchlab.operators.ids import assign_document_ids
from searchlab.operators.sampling import (
    allocate,
    fixed_size_sample,
    rare_labels,
    strata_counts,
    stratified_sample,
)
from searchlab.plans import corpus_build, views, views_sql as v
from searchlab.plans.registry import query, rounded
from searchlab.sources.readers import first_documents, read_queries, read_strings
from searchlab.sources.staging import stage
from searchlab.sources.writers import through_csv

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# --- scans ------------------------------------------------------------------
@query("scan_postings", "SELECT page_id, url, nullif(html, '') AS html FROM pages")
def scan_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages table, line breaks and quotes included, through CSV and the reader of raw files."""
    columns = ["page_id", "url", "html"]
    pages = through_csv(views.table(spark, sf, "pages").select(*columns), "pages")
    return read_strings(spark, pages, columns).withColumn("page_id", F.col("page_id").cast("long"))


@query(
    "scan_queries",
    """SELECT 'Q' || item_id AS query_id, text AS query, 'cat' || (item_id % 5) AS category
       FROM benchmark""",
)
def scan_queries(spark: SparkSession, sf: str) -> DataFrame:
    return read_queries(spark, through_csv(views.queries(spark, sf), "queries"))


@query(
    "scan_corpus_fill",
    """SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
              coalesce('q' || quality, '') AS level
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def scan_corpus_fill(spark: SparkSession, sf: str) -> DataFrame:
    labels = views.table(spark, sf, "labels")
    return (
        views.table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .select("doc_id", "lang", "text", F.concat(F.lit("q"), "quality").alias("level"))
        .fillna("")
    )


@query("first_documents", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    documents = views.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return first_documents(documents, 100)


@query(
    "head_sample",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5",
)
def head_sample(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return profile.head_sample(orders, ["o_orderkey"])


@query(
    "row_counts",
    " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS n FROM {t}""" for t in TABLES),
)
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.row_counts({t: views.table(spark, sf, t) for t in TABLES})


# --- cleaning and text ------------------------------------------------------
@query("clean_text", f"SELECT page_id, {v.cleaned('html')} AS text FROM pages")
def cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages")
    return pages.select("page_id", clean_text(F.col("html")).alias("text"))


TITLE_PATTERN = "<title>(.*?)</title>"


@query(
    "clean_postings",
    f"""SELECT page_id, url, title FROM (
          SELECT page_id, url, {v.cleaned(f"regexp_extract(html, '{TITLE_PATTERN}', 1)")} AS title
          FROM pages WHERE url IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
        WHERE title <> ''""",
)
def clean_postings(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("html", TITLE_PATTERN, 1).alias("title")
    )
    return corpus_build.clean_postings(pages, link="url", title="title", metadata=[])


@query(
    "search_text",
    f"""WITH {v.CORPUS}
        SELECT doc_id, 'Title: ' || title || '.'
               || CASE WHEN summary <> '' THEN ' Summary: ' || summary || '.' ELSE '' END
               || CASE WHEN skills <> '' THEN ' Skills: ' || skills || '.' ELSE '' END
               AS search_text
        FROM corpus""",
)
def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = search_text(F.col("title"), F.col("summary"), F.col("skills"))
    return views.corpus(spark, sf).select("doc_id", text.alias("search_text"))


@query(
    "query_tokens",
    f"""WITH {v.QUERIES}, t AS (
          SELECT query_id, regexp_extract_all(query, '[A-Za-z0-9]+') AS list FROM queries)
        SELECT query_id, unnest(list) AS token,
               generate_subscripts(list, 1) - 1 AS pos FROM t""",
)
def tokens_of_queries(spark: SparkSession, sf: str) -> DataFrame:
    asked = views.queries(spark, sf)
    return asked.select(
        "query_id", F.posexplode(query_tokens(F.col("query"))).alias("pos", "token")
    ).withColumn("pos", F.col("pos").cast("long"))


# What a full-text index with plain Latin folding makes of these words.
SCRIPT_WORDS = {
    "Ελλάδα": "ελλάδα", "καφές": "καφέσ", "ΟΔΟΣ": "οδοσ", "ёлка": "ёлка", "йод": "йод", "ЙОД": "йод",
    "Việt": "việt", "tiếng": "tiếng", "ường": "uờng", "Đà": "đa", "résumé": "resume",
    "Ångström": "angstrom", "ŠKODA": "skoda", "café": "cafe", "naïve": "naive", "ǖ": "ǖ",
    "ſenſe": "sense", "İstanbul": "istanbul", "x²": "x²", "Ｆｕｌｌ": "ｆｕｌｌ", "東京": "東京",
    "étude": "etude", "µm": "μm",
}


@query(
    "doc_tokens",
    f"""WITH t AS (SELECT doc_id, {v.tokens("text")} AS list FROM documents
               UNION ALL SELECT -1, {list(SCRIPT_WORDS.values())})
        SELECT doc_id, unnest(list) AS token, generate_subscripts(list, 1) - 1 AS pos FROM t""",
)
def tokens_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, and one more text with words of several scripts."""
    scripts = spark.range(1).select(F.lit(-1).cast("long"), F.lit(" ".join(SCRIPT_WORDS)))
    documents = views.table(spark, sf, "documents").select("doc_id", "text").unionAll(scripts)
    return documents.select(
        "doc_id", F.posexplode(document_tokens(F.col("text"))).alias("pos", "token")
    ).withColumn("pos", F.col("pos").cast("long"))


@query("token_lengths", f"SELECT doc_id, {v.words('text')} AS tokens FROM documents")
def token_lengths(spark: SparkSession, sf: str) -> DataFrame:
    documents = views.table(spark, sf, "documents")
    return documents.select("doc_id", word_count(F.col("text")).cast("long").alias("tokens"))


# --- distinct and joins -----------------------------------------------------
@query("dedup_rows", "SELECT DISTINCT * FROM conversations")
def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every row is there twice; whole rows are compared."""
    conversations = views.table(spark, sf, "conversations")
    return distinct_rows(conversations.unionAll(conversations))


@query(
    "dedup_key_first",
    """SELECT * FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def dedup_key_first(spark: SparkSession, sf: str) -> DataFrame:
    return keep_first(views.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


@query(
    "dedup_content",
    f"""WITH {v.CORPUS}
        SELECT doc_id, title FROM corpus
        QUALIFY row_number() OVER (PARTITION BY title, skills, summary ORDER BY doc_id) = 1""",
)
def dedup_content(spark: SparkSession, sf: str) -> DataFrame:
    corpus = views.corpus(spark, sf)
    return keep_first(corpus, ["title", "skills", "summary"], ["doc_id"]).select("doc_id", "title")


@query(
    "semi_join_text",
    f"""SELECT doc_id, {v.cleaned("text")} AS text FROM documents
        WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def semi_join_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts through CSV and the reader of raw files."""
    texts = through_csv(views.table(spark, sf, "documents").select("doc_id", "text"), "texts")
    texts = read_strings(spark, texts, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return corpus_build.matching_text(texts, "text", views.table(spark, sf, "labels"), "doc_id")


@query(
    "join_left_1to1",
    """SELECT doc_id, lang, source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    documents = views.table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = views.table(spark, sf, "labels")
    return documents.join(labels, "doc_id", "left").fillna(-1, subset=["quality", "toxic"])


@query(
    "join_cardinality_report",
    """SELECT 'left_key_not_unique' AS rule, count(*) AS n
       FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1)
       UNION ALL SELECT 'right_key_not_unique', count(*)
       FROM (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING count(*) > 1)""",
)
def join_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    events = views.table(spark, sf, "events").select("user_id")
    customers = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return checks.join_cardinality_report(events, customers, ["user_id"])


# --- strata and samples -----------------------------------------------------
def customer_strata(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.col(c) for c in ("n_name", "c_mktsegment", "r_name")]
    return views.customers(spark, sf).select("c_custkey", stratum_key(*parts).alias("stratum"))


@query(
    "stratum_key",
    f"WITH {v.CUSTOMERS} SELECT c_custkey, {v.CUSTOMER_STRATUM} AS stratum FROM customers",
)
def stratum_keys(spark: SparkSession, sf: str) -> DataFrame:
    return customer_strata(spark, sf)


@query("strata_counts", f"WITH {v.CUSTOMER_STRATA} SELECT * FROM counts")
def count_strata(spark: SparkSession, sf: str) -> DataFrame:
    return strata_counts(customer_strata(spark, sf))


@query("rare_strata", f"WITH {v.CUSTOMER_STRATA} SELECT * FROM labels_of")
def rare_strata(spark: SparkSession, sf: str) -> DataFrame:
    return rare_labels(strata_counts(customer_strata(spark, sf)))


def forty_percent(spark: SparkSession, sf: str) -> int:
    return views.table(spark, sf, "customer").count() * 2 // 5


FORTY_PERCENT = "(SELECT count(*) * 2 // 5 FROM customer)"


ALLOCATION_SQL = f"WITH {v.CUSTOMER_STRATA}, {v.allocation(FORTY_PERCENT)} SELECT * FROM allocation"


@query("stratified_allocation", ALLOCATION_SQL)
def stratified_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return allocate(strata_sizes(spark, sf), forty_percent(spark, sf))


@query("stratified_allocation_in_parts", ALLOCATION_SQL)
def stratified_allocation_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The form for very many strata: no task sees them all."""
    return allocate(strata_sizes(spark, sf), forty_percent(spark, sf), small=0)


def strata_sizes(spark: SparkSession, sf: str) -> DataFrame:
    merged = rare_strata(spark, sf).groupBy(F.col("merged").alias("stratum"))
    return stage(merged.agg(F.sum("size").alias("size")), "strata_sizes")


@query(
    "stratified_sample",
    f"""WITH {v.CUSTOMER_STRATA}, {v.allocation(FORTY_PERCENT)}
        SELECT key AS c_custkey, stratum FROM (
          SELECT k.key, k.stratum, n, row_number() OVER (
                   PARTITION BY merged ORDER BY {v.hashed("key")}, key) AS place
          FROM keyed k JOIN labels_of l ON k.stratum = l.stratum
          JOIN allocation a ON a.stratum = l.merged) WHERE place <= n""",
)
def sample_strata(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_sample(
        customer_strata(spark, sf), forty_percent(spark, sf), ["c_custkey"]
    ).select("c_custkey", "stratum")


@query(
    "fixed_size_sample",
    f"SELECT doc_id, lang FROM documents ORDER BY {v.hashed('doc_id')}, doc_id LIMIT 150",
)
def sample_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = views.table(spark, sf, "documents").select("doc_id", "lang")
    return fixed_size_sample(documents, 150, ["doc_id"])


@query(
    "assign_doc_id",
    f"""SELECT doc_id, printf('JOB_%07d', row_number() OVER (ORDER BY {v.hashed("doc_id")}, doc_id))
               AS job_id FROM documents""",
)
def number_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = views.table(spark, sf, "documents").select("doc_id")
    return assign_document_ids(documents, ["doc_id"])


# --- corpus build -----------------------------------------------------------
def raw_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, summaries and skills made from the documents."""
    corpus = views.corpus(spark, sf).withColumn(
        "job_link", F.concat(F.lit("doc/"), F.col("doc_id"))
    )
    jobs = corpus.select(
        "job_link",
        F.col("title").alias("job_title"),
        "company",
        F.col("country").alias("job_location"),
        F.lit(None).cast("string").alias("search_city"),
        F.col("country").alias("search_country"),
        F.lit(None).cast("string").alias("search_position"),
        F.col("level").alias("job_level"),
        F.lit(None).cast("string").alias("job_type"),
    )
    summaries = corpus.select("job_link", F.col("summary").alias("job_summary"))
    skills = corpus.select("job_link", F.col("skills").alias("job_skills"))
    return jobs, summaries, skills


SIXTY_PERCENT = "(SELECT count(*) * 3 // 5 FROM documents)"


@query(
    "build_corpus",
    f"""WITH {v.CORPUS}, raw AS (
          SELECT 'doc/' || doc_id AS job_link, {v.cleaned("title")} AS job_title,
                 {v.cleaned("company")} AS company, {v.cleaned("country")} AS country, level,
                 {v.cleaned("skills")} AS skills, {v.cleaned("summary")} AS summary
          FROM corpus),
        {v.strata("job_link", "lower(country) || ' | ' || level || ' | unknown'",
                  "(SELECT * FROM raw WHERE job_title <> '')")},
        {v.allocation(SIXTY_PERCENT)},
        chosen AS (
          SELECT key FROM (
            SELECT key, n, row_number() OVER (
                     PARTITION BY merged ORDER BY {v.hashed("key")}, key) AS place
            FROM keyed k JOIN labels_of l ON k.stratum = l.stratum
            JOIN allocation a ON a.stratum = l.merged) WHERE place <= n),
        kept AS (
          SELECT * FROM raw JOIN chosen ON job_link = key
          WHERE summary <> '' OR skills <> ''
          QUALIFY row_number() OVER (
            PARTITION BY job_title, company, country, summary ORDER BY job_link) = 1)
        SELECT printf('JOB_%07d', row_number() OVER (ORDER BY {v.hashed("job_link")})) AS doc_id,
               job_link,
               'Title: ' || job_title || '.'
               || CASE WHEN summary <> '' THEN ' Summary: ' || summary || '.' ELSE '' END
               || CASE WHEN skills <> '' THEN ' Skills: ' || skills || '.' ELSE '' END
               AS search_text
        FROM kept""",
)
def corpus_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    jobs, summaries, skills = raw_tables(spark, sf)
    size = views.table(spark, sf, "documents").count() * 3 // 5
    corpus = corpus_build.build_corpus(jobs, summaries, skills, size)
    return corpus.select("doc_id", "job_link", "search_text")


# --- profile ----------------------------------------------------------------
LENGTHS = f"""lengths AS (SELECT {v.words('text')} AS x FROM documents)"""


@query(
    "length_describe",
    f"""WITH {LENGTHS}
        SELECT count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
               min(x) AS min, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50,
               quantile_cont(x, 0.75) AS p75, max(x) AS max FROM lengths""",
)
def length_describe(spark: SparkSession, sf: str) -> DataFrame:
    described = profile.length_describe(views.table(spark, sf, "documents"), "text")
    return rounded(described, "mean", "std")


@query(
    "length_histogram",
    f"""WITH {LENGTHS}, ends AS (SELECT min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM lengths)
        SELECT least(floor((x - lo) * 40 / (hi - lo))::BIGINT + 1, 40) AS bin, count(*) AS n
        FROM lengths, ends GROUP BY 1""",
)
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_histogram(views.table(spark, sf, "documents"), "text")


PROFILED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
LABELLED = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = views.table(spark, sf, "labels")
    return views.table(spark, sf, "documents").join(labels, "doc_id", "left").select(*PROFILED)


@query(
    "null_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n FROM {LABELLED}""" for c in PROFILED
    ),
)
def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_counts(labelled(spark, sf))


@query(
    "value_counts_top",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM part
            GROUP BY {c} ORDER BY n DESC, value LIMIT 20)"""
        for c in ("p_type", "p_brand")
    ),
)
def value_counts_top(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part")
    return profile.value_counts(part, "p_type", 20).unionAll(
        profile.value_counts(part, "p_brand", 20)
    )


@query(
    "value_counts_all",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM orders GROUP BY {c}"""
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def value_counts_all(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.table(spark, sf, "orders")
    return profile.value_counts(orders, "o_orderstatus").unionAll(
        profile.value_counts(orders, "o_orderpriority")
    )


@query(
    "value_shares",
    """SELECT 'lang' AS "column", lang AS value, count(*) AS n,
              round(count(*) * 100.0::DOUBLE / (SELECT count(lang) FROM documents), 6) AS share
       FROM documents WHERE lang IS NOT NULL GROUP BY lang""",
)
def value_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.value_shares(views.table(spark, sf, "documents"), "lang"), "share")


DISTINCT = ["p_name", "p_brand", "p_type"]


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM part""" for c in DISTINCT
    ),
)
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_counts(views.table(spark, sf, "part"), DISTINCT)
