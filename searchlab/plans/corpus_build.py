"""Raw tables -> clean, deduplicated, proportionally sampled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from searchlab.functions.text import clean_text, search_text, stratum_key
from searchlab.operators.checks import join_cardinality_report, raise_violations
from searchlab.operators.dedup import keep_first
from searchlab.operators.ids import assign_document_ids
from searchlab.operators.sampling import fixed_size_sample, stratified_sample
from searchlab.sources.staging import stage

METADATA = [
    "company",
    "job_location",
    "search_city",
    "search_country",
    "search_position",
    "job_level",
    "job_type",
]
CONTENT_KEY = ["job_title", "company", "job_location", "job_summary"]


def clean_postings(
    jobs: DataFrame,
    link: str = "job_link",
    title: str = "job_title",
    metadata: list[str] = METADATA,
) -> DataFrame:
    """Distinct postings with a link and a title; text columns cleaned.

    The link is never cleaned. Of several rows with one link the first by title and then by
    all other columns stays, nulls last: a table has no file order to go by, and a row
    without a title must not win over one that has it. Copies of a whole row share
    their link, so this removes them as well without a shuffle of their own.
    """
    rest = [F.col(c).asc_nulls_last() for c in [title, *jobs.columns] if c != link]
    unique = keep_first(jobs.filter(F.col(link).isNotNull()), [link], rest)
    cleaned = unique.withColumns({c: clean_text(F.col(c)) for c in [title, *metadata]})
    return cleaned.filter(F.col(title) != "")


def matching_text(
    texts: DataFrame, text: str, keys: DataFrame, link: str = "job_link"
) -> DataFrame:
    """Cleaned text of the wanted links, one row per link."""
    wanted = texts.select(link, text).join(keys.select(link), link, "left_semi")
    return keep_first(wanted, [link], [F.col(text).asc_nulls_last()]).withColumn(text, clean_text(F.col(text)))


def build_corpus(
    jobs: DataFrame,
    summaries: DataFrame,
    skills: DataFrame,
    sample_size: int,
    final_size: int | None = None,
    link: str = "job_link",
    check_keys: bool = False,
) -> DataFrame:
    """``doc_id`` + posting columns + ``job_summary, job_skills, search_text``.

    The sample is drawn before the wide text tables are joined, and staged, because
    three joins read it. ``matching_text`` and ``clean_postings`` leave one row per
    link; ``check_keys`` verifies it with a job of its own.
    """
    cleaned = clean_postings(jobs, link).withColumn(
        "stratum",
        stratum_key(F.col("search_country"), F.col("job_level"), F.col("job_type")),
    )
    cleaned = stage(cleaned, "clean_postings")
    chosen = stage(
        stratified_sample(cleaned, sample_size, [link]).drop("stratum"), "sampled_postings"
    )
    summary = matching_text(summaries, "job_summary", chosen, link)
    skill = matching_text(skills, "job_skills", chosen, link)
    if check_keys:
        for texts in (summary, skill):
            raise_violations(join_cardinality_report(chosen, texts, [link]), "text join")
    joined = (
        chosen.join(summary, link, "left")
        .join(skill, link, "left")
        .fillna("", subset=["job_summary", "job_skills"])
        .filter((F.col("job_summary") != "") | (F.col("job_skills") != ""))
    )
    corpus = stage(keep_first(joined, CONTENT_KEY, [link]), "corpus_rows")
    if final_size is not None:
        corpus = fixed_size_sample(corpus, final_size, [link])
    numbered = assign_document_ids(corpus, [link], "doc_id")
    return numbered.select(
        "doc_id",
        link,
        "job_title",
        *METADATA,
        "job_summary",
        "job_skills",
        search_text(F.col("job_title"), F.col("job_summary"), F.col("job_skills")).alias(
            "search_text"
        ),
    )
