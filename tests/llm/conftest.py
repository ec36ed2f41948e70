import pathlib
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                       T.StructField("n_words", T.StringType()), T.StructField("node", T.StringType())])
SMALL = "/root/testdata/sf0.001"


def rows_of(texts):
    """Rows with nulls and columns whose names clash with those of the operators."""
    return [(i, t, None, None, None, "x", None, "y") for i, t in texts]


@pytest.fixture(scope="session")
def documents(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def odd(documents):
    """Null id and text, empty, blank, repeated row, a very long text."""
    return documents([(None, "no id here but some words to read"), (1, None), (2, ""), (3, " \t\n"),
                      (4, "one two three four five six seven eight nine ten eleven"),
                      (4, "one two three four five six seven eight nine ten eleven"),
                      (5, "word " * 30_000), (6, "中文 \U0001f642 123 <|endoftext|> x")])


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
