"""Ownership of partitions by nodes, as DataFrames made from a range.

The owner of partition p over the sorted nodes is nodes[p mod n]; its backups
are the nodes after it, as many as asked for and other than the owner.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import PARTITIONS


def partition_ids(spark: SparkSession, num_partitions: int = PARTITIONS) -> DataFrame:
    return spark.range(num_partitions).select(F.col("id").cast("int").alias("partition_id"))


def _nodes(nodes: Iterable[str]) -> list[str]:
    return sorted(set(nodes))


def owner_of(pid: Column, nodes: Iterable[str]) -> Column:
    """Owner expression; null without nodes."""
    known = _nodes(nodes)
    if not known:
        return F.lit(None).cast("string")
    return F.element_at(F.array(*map(F.lit, known)), (F.pmod(pid, F.lit(len(known))) + 1).cast("int"))


def backups_of(pid: Column, nodes: Iterable[str], backup_count: int = 1) -> Column:
    known = _nodes(nodes)
    n = len(known)
    names = F.array(*map(F.lit, known)) if known else None
    if n < 2 or backup_count < 1:
        return F.array().cast("array<string>")
    return F.array(*[F.element_at(names, (F.pmod(pid + b, F.lit(n)) + 1).cast("int")) for b in range(1, min(backup_count, n - 1) + 1)])


def ring(spark: SparkSession, nodes: Iterable[str], *, num_partitions: int = PARTITIONS, backup_count: int = 1) -> DataFrame:
    """partition_id, owner, backups; no rows without nodes."""
    known = _nodes(nodes)
    pids = partition_ids(spark, num_partitions if known else 0)
    p = F.col("partition_id")
    return pids.select("partition_id", owner_of(p, known).alias("owner"), backups_of(p, known, backup_count).alias("backups"))


def migrations_on_add(spark: SparkSession, nodes: Iterable[str], node: str, *, num_partitions: int = PARTITIONS) -> DataFrame:
    """partition_id, old_owner, new_owner of partitions that change owner when ``node`` joins; none if it is there already or was the first."""
    before = _nodes(nodes)
    if not before or node in before:
        return partition_ids(spark, 0).selectExpr("partition_id", "cast(null as string) old_owner", "cast(null as string) new_owner")
    p = F.col("partition_id")
    return (
        partition_ids(spark, num_partitions)
        .select("partition_id", owner_of(p, before).alias("old_owner"), owner_of(p, [*before, node]).alias("new_owner"))
        .where("old_owner <> new_owner")
    )


def migrations_on_remove(spark: SparkSession, nodes: Iterable[str], node: str, *, num_partitions: int = PARTITIONS) -> DataFrame:
    """partition_id, old_owner, new_owner of the partitions that ``node`` owned; the new owner is null when none is left."""
    before = _nodes(nodes)
    if node not in before:
        return partition_ids(spark, 0).selectExpr("partition_id", "cast(null as string) old_owner", "cast(null as string) new_owner")
    p = F.col("partition_id")
    return (
        partition_ids(spark, num_partitions)
        .select("partition_id", owner_of(p, before).alias("old_owner"), owner_of(p, [n for n in before if n != node]).alias("new_owner"))
        .where(F.col("old_owner") == node)
    )


def node_partitions(spark: SparkSession, nodes: Iterable[str], node: str, *, role: str = "primary", num_partitions: int = PARTITIONS, backup_count: int = 1) -> DataFrame:
    """partition_id of a node's partitions, ordered; any role but "primary" means backup."""
    table = ring(spark, nodes, num_partitions=num_partitions, backup_count=backup_count)
    mine = F.col("owner") == node if role == "primary" else F.array_contains("backups", node)
    return table.where(mine).select("partition_id").orderBy("partition_id")


def all_nodes(spark: SparkSession, nodes: Iterable[str]) -> DataFrame:
    """node: each known node once, ordered."""
    return spark.createDataFrame([(n,) for n in _nodes(nodes)], "node string").orderBy("node")


def held_roles(held: DataFrame, nodes: Iterable[str], *, num_partitions: int = PARTITIONS, backup_count: int = 1) -> DataFrame:
    """node, partition_id, vectors, role of copies that nodes hold (columns node, partition_id, vectors).

    A copy is its owner's "primary" or a "backup"; one that its node should
    not hold is "stale" while it has vectors, and has no row without any.
    What a node should hold and doesn't has a row of no vectors.
    """
    table = ring(held.sparkSession, nodes, num_partitions=num_partitions, backup_count=backup_count)
    due = table.select(F.col("owner").alias("node"), "partition_id", F.lit("primary").alias("role"))
    due = due.unionByName(table.select(F.explode("backups").alias("node"), "partition_id", F.lit("backup").alias("role")))
    copies = held.groupBy("node", "partition_id").agg(F.sum("vectors").alias("vectors"))
    both = copies.join(due, ["node", "partition_id"], "full").select("node", "partition_id", F.coalesce("vectors", F.lit(0)).cast("long").alias("vectors"), F.coalesce("role", F.lit("stale")).alias("role"))
    return both.where("role <> 'stale' OR vectors > 0")


def distribution(spark: SparkSession, nodes: Iterable[str], *, num_partitions: int = PARTITIONS) -> DataFrame:
    """node, partitions: nodes without a partition count 0."""
    known = _nodes(nodes)
    names = spark.createDataFrame([(n,) for n in known], "node string")
    owned = ring(spark, known, num_partitions=num_partitions).groupBy("owner").agg(F.count(F.lit(1)).alias("partitions"))
    return names.join(owned, F.col("node") == F.col("owner"), "left").select("node", F.coalesce("partitions", F.lit(0)).alias("partitions"))


def ring_stats(spark: SparkSession, nodes: Iterable[str], *, num_partitions: int = PARTITIONS) -> DataFrame:
    """One row: nodes, partitions, min_per_node, max_per_node, ideal_per_node (nulls without nodes)."""
    return distribution(spark, nodes, num_partitions=num_partitions).agg(
        F.count(F.lit(1)).alias("nodes"), F.lit(num_partitions).cast("long").alias("partitions"),
        F.min("partitions").alias("min_per_node"), F.max("partitions").alias("max_per_node"),
        F.when(F.count(F.lit(1)) > 0, F.lit(float(num_partitions)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("ideal_per_node"),
    )
