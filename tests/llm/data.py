"""Small documents with the awkward cases every operator has to stand."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("spans", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("ids", T.StringType())])

LONG = "The quick brown fox jumps over the lazy dog near the old river bank. " * 3000


def awkward(spark):
    """Null, empty, blank and very long texts, ties, a repeated row, a null id, extra columns with clashing names."""
    rows = [
        (1, "Plain words stand here, and a few more of them follow.", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", None), (5, LONG, "en"),
        (6, "Plain words stand here, and a few more of them follow.", "en"), (6, "Plain words stand here, and a few more of them follow.", "en"),
        (None, "A text without an id.", "en"), (8, "naïve Ünïcödé 日本語 \U0001f600   x", None), (9, "x" * 30000, None), (10, "one", None)]
    return spark.createDataFrame([(i, t, lang, None, len(t or ""), "s", "c", "d") for i, t, lang in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
