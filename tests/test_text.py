"""Hand cases of the text expressions."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from searchlab.functions import text as t
from searchlab.plans.catalog_corpus import SCRIPT_WORDS


def values(spark, column, *rows):
    schema = ", ".join(f"c{i} string" for i in range(len(rows[0])))
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


CASES = {
    "a&lt;b&gt;c  \x01C++ &amp; .NET": "a c C++ & .NET",
    "C# &nbsp; .NET  x": "C# .NET x",
    "<p>one<br/>two</p>\n\n three\t": "one two three",
    "1 < 2 and 3 > 2": "1 2",
    "&eacute;t&eacute; &copy 2024 &notanentity;": "été © 2024 ¬anentity;",
    " line sep\x85next\x1cfile": "line sep next file",
    "": "",
    None: "",
}


@pytest.mark.parametrize("case", CASES)
def test_clean_text(spark, case):
    assert values(spark, t.clean_text(F.col("c0")), (case,)) == [CASES[case]]


def test_group_value(spark):
    got = values(spark, t.group_value(F.col("c0")), (None,), ("  ",), ("Mid &amp; Senior",))
    assert got == ["unknown", "unknown", "mid & senior"]


def test_stratum_key(spark):
    key = t.stratum_key(F.col("c0"), F.col("c1"), F.col("c2"))
    assert values(spark, key, ("United States", None, "Onsite")) == [
        "united states | unknown | onsite"
    ]


def test_search_text(spark):
    text = t.search_text(F.col("c0"), F.col("c1"), F.col("c2"))
    assert values(spark, text, ("T", "", "S"), ("T", "M", ""), ("T", "M", "S")) == [
        "Title: T. Skills: S.",
        "Title: T. Summary: M.",
        "Title: T. Summary: M. Skills: S.",
    ]


def test_tokens(spark):
    assert values(spark, t.query_tokens(F.col("c0")), ("CI/CD with C++",)) == [
        ["CI", "CD", "with", "C"]
    ]
    assert values(spark, t.document_tokens(F.col("c0")), ("snake_case Résumé x² ÅNGSTRÖM",)) == [
        ["snake", "case", "resume", "x²", "angstrom"]
    ]
    # A combining mark belongs to its letter.
    assert values(spark, t.document_tokens(F.col("c0")), ("café ΣΑΣ",)) == [["cafe", "σασ"]]


@pytest.mark.parametrize("text", ["", "  ", "one", " a b c \n d ", "x\x1cy"])
def test_word_count_like_python_split(spark, text):
    assert values(spark, t.word_count(F.col("c0")), (text,)) == [len(text.split())]


def index_tokens(texts):
    """Tokens that SQLite's full-text index makes of each text."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    found = [[] for _ in texts]
    for term, doc in db.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        found[doc].append(term)
    return found


def test_letters_fold_as_in_the_index(spark):
    """Every letter of Latin, Greek, Cyrillic and Vietnamese blocks, and every mark behind a letter."""
    letters = [chr(p) for p in [*range(0xAA, 0x370), *range(0x370, 0x528), *range(0x1E00, 0x2000)]]
    # A letter newer than the tables of the index.
    unknown = {chr(0x37F)}
    texts = [f"x{c}y" for c in letters if (c.isalpha() or 0x300 <= ord(c) < 0x332) and c not in unknown]
    want = index_tokens(texts)
    got = values(spark, t.document_tokens(F.col("c0")), *[(x,) for x in texts])
    assert [(x, g) for x, g, w in zip(texts, got, want) if g != w] == []
    assert len(texts) > 1100


def test_script_words_fold_as_in_the_index(spark):
    want = index_tokens(list(SCRIPT_WORDS))
    assert [[w] for w in SCRIPT_WORDS.values()] == want
    assert values(spark, t.document_tokens(F.col("c0")), *[(w,) for w in SCRIPT_WORDS]) == want
