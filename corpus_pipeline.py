"""The training-data pipeline: five stages over ``documents``.

Each stage takes what its predecessor kept, written as Parquet and read again,
and its decisions take effect on the rows.  All but the last keep the columns
of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.decontaminate import decontaminate
from vecloom.llm.mixing import mixed_documents
from vecloom.llm.ngram_join import keep_one
from vecloom.llm.quality import keep_good
from vecloom.llm.tokens import default_tokenizer, read_documents, write_shards
from vecloom.workspace import discard, scope, stored

#: Near duplicates of the pipeline: words in a shingle, and the least Jaccard similarity in hundredths.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; null and empty texts have scores too, repeated rows share theirs."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies.

    Texts without words are groups of their own; rows without an id, which no
    group can name, stay; rows that repeat a kept id stay with it.
    """
    return keep_one(docs, width=SHINGLE_WORDS, num=SIMILARITY, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that benchmark items share, their length with them, and without those that are mostly such spans.

    Null and empty texts, and rows without an id, stay; a clean text stays as
    it is to the byte.
    """
    clean = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once or twice, or not at all; a null source is a source."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and checksum of each document in the token files; null and empty texts are an end id alone."""
    return read_documents(*write_shards(docs, default_tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Trained scores and token files are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage made on its way, and what it read, goes when its rows are stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark) as own:
            kept = stored(stage(spark, docs, sf_dir), name)
            own.keep(kept)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
