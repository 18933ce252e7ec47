import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with results."""

    def make(rows):
        rows = [(i, t, "en", f"s{k % 2}", len(t or ""), -1, -1) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, kept int"
        )

    return make
