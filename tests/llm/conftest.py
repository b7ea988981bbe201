import pytest


@pytest.fixture()
def documents(spark):
    """Make a documents table with columns whose names may clash with inner ones."""
    def make(rows):
        data = [(i, t, "en", "src0", len(t or ""), "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, class string, n long, keep_id string")
    return make
