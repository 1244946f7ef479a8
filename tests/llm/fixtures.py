"""Small frames of documents with the awkward cases."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use for columns of their own
    T.StructField("n_words", T.StringType()), T.StructField("row", T.StringType()), T.StructField("d", T.StringType()),
    T.StructField("rank", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("digest", T.StringType())])

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Ünïcode ÄÖ straße 日本語 text"), (6, LONG), (7, LONG), (8, LONG + " tail"),
    (9, "a b c d e f g h i j k l m n o p q r s t"), (9, "a b c d e f g h i j k l m n o p q r s t"), (9, "another text under one id"),
    (None, "a text without an id"), (None, "a text without an id"), (None, None), (10, "###!!! 123 ...\n\n\n|"),
    (11, "x" * 5000), (12, "line one of it\nline two of it\nline one of it\n\nline two of it"), (13, "double  space and <|endoftext|> inside \n\n end ")]


def documents(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if t else None, None, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def key(row):
    """Sorts rows with nulls."""
    return tuple((v is not None, v) for v in row)
