import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
#: Columns that share names with what the operators use inside.
CLASHING = ("k0", "t", "fp", "sum", "size", "key", "label", "score", "word", "block", "rep", "v", "id")


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from rows (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).select("*", *[F.lit("x").alias(c) for c in CLASHING])

    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame([(r[0], r[1], r[1]) for r in rows], LABELS)
