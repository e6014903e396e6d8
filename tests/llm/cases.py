"""Rows that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHING = ("u", "v", "rep", "d", "id", "_id", "_n", "_th", "_spans", "_kept", "h", "p", "x", "size", "copies", "block", "rank", "k", "i", "score", "_score", "key", "gram", "w", "n", "at", "label")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edgy(spark: SparkSession) -> DataFrame:
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns of clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(200_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1), (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "de", "b", 4), (5, long, "en", "b", len(long)), (None, "a text without an id", "fr", "a", 20),
        (None, None, None, None, None), (6, "one", "en", None, 3), (7, "THE quick brown fox jumps over the lazy dog again and again", "en", "b", 1), (8, "\x00 \x1a ]</s> é 日本 <|endoftext|> 😀", "en", "c", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHING])


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
