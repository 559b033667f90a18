import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with every awkward case: null ids and texts, empty and
    long texts, ties, repeated rows, and a column that clashes with ours."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "clash", 1, "x", "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id string, n int, found string, `a.b` string")

    return make
