from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, n int, key string, line string, node int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeats, a long text, clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and runs far away from here"
    secret = "password = hunter2hunter2 and " + "0123456789abcdef" * 2
    rows = [
        (1, prose, "en", "a", 5), (1, prose, "en", "a", 5), (2, prose, "en", "b", 5), (3, None, None, None, None),
        (4, "", "en", "a", 0), (5, " \t\r\n ", "en", None, 5), (None, prose + " again", "en", "c", 9),
        (None, None, "de", "d", 1), (6, "x", None, "a", 1), (7, "wordé " * 30_000, "fr", "e", 1),
        (8, secret, "en", "a", 3), (9, "Line one\n" + prose + "\n\nlast", "en", "f", 2), (9, "other text", "en", "g", 2),
    ]
    extra = ("i", "f", 1, "k", "l", 0)
    return spark.createDataFrame([r + extra for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
