"""Awkward document tables and helpers for the operators' tests."""

import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, "One. Two three four five six seven.", "en", "a", 35),
    (4, "One. Two three four five six seven.", "en", "a", 35),
    (5, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "b", 63),
    (6, "word " * 60_000, "en", "a", 300_000),
    (7, "x" * 200_000, "en", "a", 200_000),
    (8, "under the MIT license, see cc by nc; call +44 (0)20 7946 0958 or a.b@c.de", None, "b", None),
    (None, "no id but text under the mit license", "en", "b", 36),
]


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names operators use inside."""
    docs = spark.createDataFrame(AWKWARD, DOCS)
    for name in ("row", "words", "key", "length", "piece", "score", "me", "hub", "number", "task", "place"):
        docs = docs.selectExpr("*", f"'clash' as {name}")
    return docs


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(table: str):
    return pd.read_parquet(table)


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((r[df.columns.index(c)] is None, r[df.columns.index(c)] or 0) for c in order) or tuple(map(str, r)))
