import pytest

#: Columns of documents, and columns that clash with names the operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size int, h int, word string, lines string, score string, label int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with clashing columns."""

    def build(rows):
        full = [(*r, *([None] * (4 - len(r))), len(r[1] or ""), 7, 7, 7, "x", "y", "z", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build
