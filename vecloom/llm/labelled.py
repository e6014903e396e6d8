"""Bounded samples of labelled rows, for the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Texts turned into features at once.
ROWS = 400


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod))


def sample(labels: DataFrame, label: str, train: Column, per_class: tuple[int, int]) -> tuple[DataFrame, float]:
    """Up to ``per_class`` rows of label 0 and 1 among those that ``train``
    allows, those of the smallest hash, and the share of label 1 in all of
    them.  Rows without an id or with another label are ignored; of an id with
    several labels the smallest counts.
    """
    rows = (
        labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(train)
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    share = rows.agg(F.avg("label")).first()[0]
    parts = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[c]) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), 0.5 if share is None else float(share)


def chosen_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label, h (the text's hash), text of the chosen documents."""
    # a sample is bounded by its parameter, so its ids may go to every task
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return picked.select("doc_id", "label", F.xxhash64("text").alias("h"), "text")


def gathered(docs: DataFrame, chosen: DataFrame, featurise) -> list:
    """(id, features bytes, label) of the chosen documents, in order of id: one
    for each id, the text of the smallest hash where an id has several, so the
    driver gets at most as many rows as the sample's documented bound.

    ``featurise`` maps a string array to a list of bytes of a bounded size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                yield pa.record_batch([*part.columns[:3], pa.array(featurise(part.column(3)), pa.binary())], ["doc_id", "label", "h", "x"])

    feats = chosen_texts(docs, chosen).mapInArrow(rows, f"doc_id {kind}, label int, h long, x binary")
    got = feats.groupBy("doc_id", "label").agg(F.min(F.struct("h", "x")).alias("m")).select("doc_id", "label", "m.x").collect()
    return sorted(((r["doc_id"], bytes(r["x"]), r["label"]) for r in got), key=lambda r: r[0])
