import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and then it runs away from here to there with all of its many friends who like it"


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns named like results."""
    long_ = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    rows = [
        (1, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (3, "", "en", "b", 0), (4, None, "en", "b", 0), (5, " \t\n ", None, None, None), (None, PROSE + " x", "en", "c", 1), (6, long_, "de", "a", 5),
        (7, "one", "en", None, 3), (8, "one two three", "en", "b", 3), (9, "é" * 30 + " password = hunter2hunter2", "fr", "b", 3), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(0).alias(c) for c in ("kept", "size", "fp", "part", "row", "ids", "first", "block", "component_id", "spans", "n", "key", "digest", "count", "seed", "_kept")])


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
