from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, row string, h string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, blank, repeated and very long rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e f g h", "en", "s", 15, "x", "y", "z"), (2, None, None, None, None, None, None, None), (None, "a b c d e f g h", "en", None, 15, "", "", ""),
            (3, "", "en", "s", 0, "u", "r", "h"), (4, " \n\t\n", "en", "s", 4, "u", "r", "h"), (1, "a b c d e f g h", "en", "s", 15, "x", "y", "z"),
            (5, long, "en", "t", len(long), "u", "r", "h"), (6, long + " tail", "en", "t", len(long) + 5, "u", "r", "h"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
