import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, parts=3):
        full = [(i, t, "en", rest[0] if rest else f"s{i}", len(t) if t is not None else None) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)

    return make
