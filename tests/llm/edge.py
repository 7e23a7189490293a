"""Rows that every operator must take: nulls, empties, long texts, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 20_000 + "é" * 5_000
ROWS = [
    (1, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27),
    (3, None, None, None, None), (4, "", "en", None, 0), (5, " \t\n\x0b\x0c\r", "en", "b", 6), (None, "a text without id", "en", "b", 17), (6, LONG, "en", "b", len(LONG)),
    (7, "\n".join(["the same long line that is shared by many documents here"] * 3), "de", "c", 10),
]


def docs(spark, rows=None):
    """The rows with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    for c in ("row", "key", "keys", "size", "of", "id", "rep", "root", "a", "b", "ids", "packed", "spans", "weight", "score"):
        df = df.withColumn(c, F.lit("extra"))
    return df


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
