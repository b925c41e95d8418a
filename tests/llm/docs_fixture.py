from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from texts, or from (doc_id, text[, source]) tuples."""
    def make(items):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(items)]
        return spark.createDataFrame(
            [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows], DOCS)
    return make
