"""Fixtures of tables with odd rows."""

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

TEXTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as a table."""
    return lambda rows: spark.createDataFrame(rows, TEXTS)


ODD = ["", None, " \n\t ", "a", "\n\n", "É ß 你好 🎉", "x" * 70_000, "word " * 9000, "A b\r\nC\x0bd \x00 e"]


@pytest.fixture
def odd(docs):
    """Null ids, null, empty and very long texts, repeated rows."""
    return docs([(i, t) for i, t in enumerate(ODD)] + [(None, "a b c d e f"), (None, None), (3, "a"), (3, "a"), (3, "other")])


@pytest.fixture
def no_rows(docs):
    return docs([])
