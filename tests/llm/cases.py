"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashes."""

from __future__ import annotations

CLASHING = "part rest bytes salt n rep key comp place rank shift lang score x base more kept _gone _row_key".split()
LONG = "long words here " * 3000
ROWS = [
    (1, "a b c d e f g"), (2, None), (3, ""), (4, "a b c d e f g"), (None, "nobody's text"), (None, None),
    (5, LONG), (6, LONG), (6, LONG), (7, LONG + "end"), (8, "  \n\t "), (9, "ein Wort"), (10, "w" * 20000),
    (11, "Mail me: a.b@example.com or +1 (234) 555-6789, card 4111 1111 1111 1111 at 10.0.0.1."),
]


def edge_documents(spark):
    names = ["doc_id", "text", *CLASHING]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(*row, *(f"{c}!" for c in CLASHING)) for row in ROWS]
    return spark.createDataFrame(rows, schema).select(*names)


def no_documents(spark):
    return edge_documents(spark).filter("doc_id < -1")


def small_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
