"""Tables with awkward rows for the corpus operators' tests."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, fp string, part int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = "the end of it. " * 20_000
    rows = [
        (1, "Hello World. This is it!", "en", "b", 24, "x", "f", 1),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, "x", "f", 2),
        (4, long_text, "en", "a", len(long_text), "x", "f", 2),
        (5, "same text here now", "en", "a", 18, "x", "f", 2),
        (5, "same text here now", "en", "a", 18, "x", "f", 2),
        (6, "same text here now", "en", "b", 18, "x", "f", 2),
        (7, "Élan über日本🙂 ' \t\n naïve's", "fr", "c", 30, "x", "f", 2),
        (None, "no id but text", "en", None, 14, "x", "f", 2),
        (None, None, None, None, None, None, None, None),
        (8, "   \n\t ", "en", "c", 6, "x", "f", 2),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
