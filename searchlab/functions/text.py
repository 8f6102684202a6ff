"""Text cleaning, stratum keys, search text and tokens as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# --- fixed values -----------------------------------------------------------
# Patterns whose meaning must match the data contract exactly.
TAG_PATTERN = r"<[^>]+>"
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
QUERY_TOKEN_PATTERN = r"[A-Za-z0-9]+"
DOCUMENT_TOKEN_PATTERN = r"[\p{L}\p{N}\p{Co}]+"
BETWEEN_TOKENS_PATTERN = r"[^\p{L}\p{N}\p{Co}]+"
# Unicode white space: Java's \s needs (?U) and leaves out four separators.
SPACE_PATTERN = r"(?U)[\s\x1c-\x1f]+"
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "
UNKNOWN_GROUP = "unknown"
# ----------------------------------------------------------------------------


def _folding_alphabet() -> tuple[str, str]:
    """Lower-case letters and what an index takes them for.

    A Latin letter with one diacritic counts as the plain letter; with two it keeps both, and
    other scripts keep theirs. Letter variants that only case folding unites (final sigma,
    long s) count as the common form. The marks that stand behind a Latin letter without
    changing its place in the alphabet are listed last without a counterpart, which deletes them.
    """
    letters = "abcdefghijklmnopqrstuvwxyz"
    marks = [chr(p) for p in range(0x300, 0x370) if unicodedata.normalize("NFC", chr(p)) == chr(p)]
    composed = {unicodedata.normalize("NFC", b + m): (b, m) for b in letters for m in marks}
    composed = {c: pair for c, pair in composed.items() if len(c) == 1}
    folded = {c: base for c, (base, _) in composed.items()}
    for char in map(chr, [*range(0x80, 0x400), *range(0x1E00, 0x2000)]):
        common = char.casefold()
        if char == char.lower() and len(common) == 1 and common != char:
            folded[char] = folded.get(common, common)
    gone = sorted({mark for _, mark in composed.values()})
    return "".join([*folded, *gone]), "".join(folded.values())


FOLD_FROM, FOLD_TO = _folding_alphabet()


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """Resolve HTML entities; Spark has no native function for it."""
    return text.map(html.unescape, na_action="ignore")


def strip_markup(text: Column) -> Column:
    """Native part of the cleaning: tags, control characters, white space."""
    text = F.regexp_replace(text, TAG_PATTERN, " ")
    text = F.regexp_replace(text, CONTROL_PATTERN, " ")
    return F.trim(F.regexp_replace(text, SPACE_PATTERN, " "))


def clean_text(text: Column) -> Column:
    """Entities first, so that an escaped tag is removed like a plain one."""
    return strip_markup(unescape_html(F.coalesce(text.cast("string"), F.lit(""))))


def group_value(text: Column) -> Column:
    cleaned = F.lower(clean_text(text))
    return F.when(cleaned == "", UNKNOWN_GROUP).otherwise(cleaned)


def stratum_key(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[group_value(p) for p in parts])


def search_text(title: Column, summary: Column, skills: Column) -> Column:
    """One labelled sentence per non-empty part; the title is always there."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("Title: "), title, F.lit(".")),
        F.when(summary != "", F.concat(F.lit("Summary: "), summary, F.lit("."))),
        F.when(skills != "", F.concat(F.lit("Skills: "), skills, F.lit("."))),
    )


def query_tokens(text: Column) -> Column:
    """ASCII letter/digit runs; order and duplicates are kept."""
    return F.regexp_extract_all(text, F.lit(QUERY_TOKEN_PATTERN), F.lit(0))


def _folded(text: Column) -> Column:
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def document_tokens(text: Column) -> Column:
    """Letter/number runs, lower-cased, Latin letters without their diacritic."""
    return F.regexp_extract_all(_folded(text), F.lit(DOCUMENT_TOKEN_PATTERN), F.lit(0))


def document_words(text: Column) -> Column:
    """The tokens of ``document_tokens`` as one text, with a space between each two."""
    return F.trim(F.regexp_replace(_folded(text), BETWEEN_TOKENS_PATTERN, " "))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for an empty text."""
    return F.regexp_count(text, F.lit(WORD_PATTERN))
