import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows, with a column whose name clashes."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        from pyspark.sql import functions as F

        return spark.createDataFrame(full, SCHEMA).withColumns({"score": F.lit("x"), "start": F.lit(1), "kept": F.lit("y"), "n_words": F.lit(2)})

    return make


@pytest.fixture(scope="session")
def sample(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


#: Nulls, empty and white texts, repeated rows and ids, no id, ties.
EDGES = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one"), (5, "one two"), (5, "one two"), (6, "one two three four five six seven"), (7, "ONE two three four five six seven"),
    (None, "one two three four five six seven"), (None, None), (8, "Ünïcödé 😀 straße\x85x y\x1cz"), (9, "a" * 5000), (10, "42 17 !!"), (11, "same words same words " * 40), (12, "<|endoftext|> İ, x"),
]


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(*EDGES)


@pytest.fixture(scope="session")
def empty(docs_of, spark):
    return docs_of((1, "x")).where("doc_id < 0")
