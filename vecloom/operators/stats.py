"""Counts by partition, node and role: partial sums on every task, one small result."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PARTITIONS
from .ring import distribution, ring


def partition_counts(placed: DataFrame, num_partitions: int = PARTITIONS) -> DataFrame:
    """partition_id, vectors for partitions that hold any."""
    return placed.groupBy("partition_id").agg(F.count(F.lit(1)).alias("vectors"))


def cluster_size(placed: DataFrame) -> DataFrame:
    return placed.agg(F.count(F.lit(1)).alias("vectors"))


def sizes_by_node(placed: DataFrame, nodes: Iterable[str], *, num_partitions: int = PARTITIONS, backup_count: int = 1) -> DataFrame:
    """node, primary_partitions, backup_partitions, primary_vectors, backup_vectors; every node has a row.

    Vectors are counted by partition first, so the join with the ring has one
    row a partition however large the table.
    """
    spark, nodes = placed.sparkSession, list(nodes)
    counts = partition_counts(placed)
    table = ring(spark, nodes, num_partitions=num_partitions, backup_count=backup_count).join(counts, "partition_id", "left").withColumn("vectors", F.coalesce("vectors", F.lit(0)))
    first = table.groupBy(F.col("owner").alias("node")).agg(F.count(F.lit(1)).alias("primary_partitions"), F.sum("vectors").alias("primary_vectors"))
    second = table.select(F.explode("backups").alias("node"), "vectors").groupBy("node").agg(F.count(F.lit(1)).alias("backup_partitions"), F.sum("vectors").alias("backup_vectors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        distribution(spark, nodes, num_partitions=num_partitions).select("node").join(first, "node", "left").join(second, "node", "left")
        .select("node", zero("primary_partitions"), zero("backup_partitions"), zero("primary_vectors"), zero("backup_vectors"))
    )


def local_size(placed: DataFrame, nodes: Iterable[str], node: str, **how) -> DataFrame:
    """vectors of the partitions that a node owns."""
    return sizes_by_node(placed, nodes, **how).where(F.col("node") == node).select(F.col("primary_vectors").alias("vectors"))


def local_backup_size(placed: DataFrame, nodes: Iterable[str], node: str, **how) -> DataFrame:
    """vectors of the partitions that a node backs up."""
    return sizes_by_node(placed, nodes, **how).where(F.col("node") == node).select(F.col("backup_vectors").alias("vectors"))


def dead_members(beats: DataFrame, timeout_s: float, *, now=None, node: str = "node_id", ts: str = "ts") -> DataFrame:
    """Nodes whose last beat is more than ``timeout_s`` before ``now`` (a column or literal; else the newest beat of all)."""
    last = beats.groupBy(node).agg(F.max(ts).alias("last_seen"))
    if now is None:
        last = last.join(F.broadcast(beats.agg(F.max(ts).alias("_now"))))
    else:
        last = last.withColumn("_now", now)
    silent = F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return last.where(silent > int(timeout_s * 1e6)).select(node, "last_seen")
