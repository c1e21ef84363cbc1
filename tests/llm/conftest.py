import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Nulls in every column, empty and blank texts, a repeated row, repeated ids, a very long text.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all", "en", None, None),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (5, " \t\n ", "de", "b", 4),
    (None, "no id here", "en", "c", 10),
    (6, "ünïcödé wörds Ärger 東京 \U0001f600", "xx", "ü", 20),
    (7, "word " * 30_000, "en", "a", 150_000),
    (8, "x" * 50_000, "en", "a", 50_000),
    (9, "1" * 20_000 + " " + "a@" * 500 + "b.c", None, "a", 1),
    (2, "a second text of document two", "en", "b", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash(odd):
    """Extra columns with names that operators might use."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(["shard", "slot", "spans", "n_words", "secrets", "toxicity", "accepted", "threshold", "size", "fp", "position", "k", "code", "n", "count", "component", "own"])])


@pytest.fixture(scope="session")
def texts(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
