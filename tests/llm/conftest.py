import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 9, "x"),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 9, "x"),
        (2, None, "en", "a", None, None),
        (3, "", None, None, 0, "y"),
        (4, "  \n\t ", "de", "b", 5, "y"),
        (5, LONG, "en", "b", len(LONG), "z"),
        (6, LONG, "en", "b", len(LONG), "z"),
        (None, "alpha beta gamma delta epsilon zeta", "de", None, 1, "z"),
        (7, "Ünï cödé 日本語 😀 text", "de", "c", 3, "z"),
        (8, "ab", "en", "c", 2, "z"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
