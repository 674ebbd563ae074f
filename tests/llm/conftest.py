import pytest
from conftest_words import words
from pyspark.sql import types as T

import __spark_entry__ as entry_module  # noqa: F401  (puts the repository on the path)

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("row", T.StringType()),
        T.StructField("n_words", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def stored_docs(spark, tmp_path_factory):
    """A function that stores rows (doc_id, text) as a documents table with more columns."""

    def store(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 5) for i, t in rows]
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame(full, DOCS).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return store


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied rows, and a null key."""
    long = " ".join(words(1, 30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, long),
        (5, "one"),
        (5, "one"),
        (6, "Two words"),
        (None, "two words"),
        (7, "ééé 日本 😀 " * 40),
        (8, long),
        (9, "x" * 50_000),
    ]
