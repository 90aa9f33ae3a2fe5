import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    a = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, a, "en", "s", "x"), (2, a, "en", "s", "x"), (2, a, "en", "s", "x"), (3, a.replace("word30", "other"), None, None, None), (4, None, "en", None, "y"), (5, "", "de", "s", "y"),
        (6, "one two", "de", "s", "y"), (7, "ONE  two\n", "de", "s", "y"), (None, a, None, "s", None), (8, " ".join(f"w{i % 997}" for i in range(60_000)), "en", "t", "z"), (9, "é ü 日本 \U0001f600 x", "fr", "t", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
