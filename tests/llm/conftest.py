import pytest

from .brute import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, repeated ids, null ids, and columns whose names operators use themselves."""
    long = "one two three four five six seven eight nine ten eleven " * 8
    data = [(1, long, "en", "src0", 1), (1, long, "en", "src0", 1), (1, "another text", "en", "src0", 1), (None, long + "x", None, None, None), (None, None, "de", "src9", None)]
    df = spark.createDataFrame(data, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in ("shard", "votes", "items", "fp", "score", "n_words", "licence", "id", "start", "_id", "_hash", "_id_", "_q_votes", "_row", "count", "print", "windows")})
