import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, repeated ids, a null id, and extra columns with clashing names."""
    long = "word " * 30_000
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n", "en", "s", 3),
        (4, long, "en", "s", len(long)),
        (5, "alpha beta gamma delta epsilon zeta", "en", "t", 35),
        (5, "alpha beta gamma delta epsilon zeta", "en", "t", 35),
        (6, "alpha beta gamma delta epsilon zeta", None, None, 35),
        (7, "one other text", "de", "t", 14),
        (7, "quite another text of it", "de", "t", 24),
        (None, "no id here at all", "fr", "u", 17),
        (8, "!!! ???", "fr", "u", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS node", "'x' AS key", "2 AS a", "3 AS part", "'y' AS _id", "'z' AS size", "0 AS ids", "true AS kept")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
