import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text, source)."""

    def make(rows, extra=""):
        full = []
        for k, row in enumerate(rows):
            i, text, source = row if isinstance(row, tuple) else (k, row, "s")
            full.append((i, text, "en", source, len(text) if text is not None else None))
        return spark.createDataFrame(full, COLUMNS)

    return make
