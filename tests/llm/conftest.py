import math

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Rows with missing values, empty and long texts, repeats, and columns whose names operators use themselves."""
    rows = [(1, "the cat and the dog of the house " * 40, "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0),
            (4, "   \n\t ", "de", "b", 6), (5, "der hund und die katze in dem haus " * 30, "de", None, 7),
            (6, "12345 ... 678", "en", "b", 3), (1, "the cat and the dog of the house " * 40, "en", "a", 5),
            (None, "no id here", None, "c", 10), (7, "x" * 30_000, "en", "c", 1), (8, "déjà vu — 日本語 🙂  two  blanks ", "fr", "a", 9)]
    return spark.createDataFrame([(*r, "clash", 1.5, True) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, h string, size double, kept boolean")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
