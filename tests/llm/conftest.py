import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a table of documents from (doc_id, text) rows, with columns that clash with internal names."""

    def make(rows, lang="en"):
        full = [(i, t, lang if t else None, "s", len(t) if t is not None else None, 1, 2, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key int, copies int, TEXT_ string").withColumnRenamed("TEXT_", "Text")

    return make


#: Empty, null, blank, repeated and odd rows; ties in doc_id.
EDGES = [(1, ""), (2, None), (3, " \n\t "), (4, "one two"), (4, "one two"), (4, "other words here"), (None, "one two"), (None, None), (7, "a" * 5000), (8, "ein über größer 日本 \U0001f600 ñ"), (9, "one two"), (10, "x " * 3000)]
EXPECT = len(EDGES)


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(EDGES)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
