import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon " * 3000
#: nulls in every column, empty and blank texts, repeated rows and ids, ties, a very long text
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
    (2, "the quick  brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
    (2, "the quick  brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (5, " \t\n", "de", "b", 3),
    (6, LONG, "en", None, len(LONG)),
    (None, "ein kurzer Text mit wenigen Wörtern 😀 über Straßen", "de", "c", None),
    (7, "x", None, "c", 1),
    (8, "12345 678 !!", "fr", "c", 12),
    (1 << 53, "ids that no double holds", "en", "c", 24),
    ((1 << 53) + 1, "ids that no double holds either", "en", "c", 31),
    ((1 << 63) - 1, "the greatest id of all", "en", "d", 22),
    (-(1 << 63), "the least id of all", "en", "d", 19),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows, with an extra column whose name clashes with names used inside."""
    return spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, key string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def docs_pd():
    return pd.read_parquet(f"{SF}/documents.parquet")
