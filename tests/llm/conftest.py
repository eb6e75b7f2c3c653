import pytest


@pytest.fixture
def docs_of(spark):
    """Makes a documents table of (doc_id, text, lang, source), with columns whose names the operators use themselves."""

    def make(rows):
        rows = [(i, t, lang, source, None if t is None else len(t), -1, "x", True, "?") for i, t, lang, source in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, entry string, kept boolean, score string").repartition(3)

    return make
