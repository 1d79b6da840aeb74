from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

LONG = " ".join(f"word{i % 997} other{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents with all the awkward cases, and a column whose name the operators use themselves."""
    copies = "the quick brown fox jumps over the lazy dog near the old river bank every morning"
    rows = [
        (1, copies, "en", "a"), (2, copies, "en", "b"), (2, copies, "en", "b"), (3, copies + " again", None, None), (4, None, "en", "a"),
        (5, "", "fr", "a"), (6, "   \n\t ", None, "b"), (7, "one two three", "en", None), (8, "One TWO three", "en", "c"), (9, LONG, "de", "a"),
        (None, "lost and found without any number at all today", None, "c"), (None, None, None, None), (10, "x" * 100_000, "en", "c"),
        (11, "日本 語の 文 章 です が 何か", "ja", "c"), (12, "tab\there  two  blanks\n\nand lines ", "en", "a"),
    ]
    return spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, row long")


@pytest.fixture(scope="session")
def nothing(docs) -> DataFrame:
    return docs.limit(0)
