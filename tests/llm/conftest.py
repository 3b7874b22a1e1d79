import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 977}x{k}" for k in range(60_000))
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, LONG), (5, "the same text twice over and over"), (5, "the same text twice over and over"),
    (6, "the same text twice over and over"), (None, "a row without an id"), (7, "é 世界 🎉 ▁ \x00 x"), (8, "one"), (9, "a b c d"), (10, "x" * 70_000),
    (11, "mail a.b@c.example, card 4929 1111 2222 3334, token=abcdefghijk1 +1 (555) 010-9999 10.0.0.1"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["size", "v", "root", "n", "k1", "bucket", "score", "words", "a", "b", "spans", "ids", "u", "copies", "rep", "block", "grams", "gone", "key"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators might use."""
    rows = [(i, t, None if (i or 0) % 2 else "en", None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", None) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
