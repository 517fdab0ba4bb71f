import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use themselves.
    T.StructField("score", T.DoubleType()), T.StructField("node", T.StringType()), T.StructField("lang_pred", T.StringType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), 0.5, "n", "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
