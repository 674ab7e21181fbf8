import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"

#: Null, empty, blank and very long texts, ties and repeated rows; an id is missing, one comes twice.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 40_000), (5, "one two three four five six"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "no id here, only a text"), (7, "é ☃ 🎉 \x00")]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    # columns that operators use inside, with other meanings
    return df.select("*", *(F.lit("x").alias(c) for c in ("label", "score", "h", "key", "node", "n_chars2", "found", "token_ids", "batch")))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
