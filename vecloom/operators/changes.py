"""Change logs of vectors: last writer wins, tombstones, snapshots with tails.

A log row is (partition_id, version, op, vector_id, embedding, metadata) with
op ``insert`` or ``delete``.  Versions count within a partition, and an id has
one partition, so the highest version of an id is its last write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, DELETE = "insert", "delete"


def latest(log: DataFrame, *, id_col: str = "vector_id", version: str = "version") -> DataFrame:
    """The last entry of every id, tombstones included.

    The entry is found on narrow rows, (id, version, a key of eight bytes),
    aggregated before the shuffle, so an id written a million times moves one
    of them a task; whole rows are then joined by all three, so such an id's
    entries don't meet.  Of equal versions a delete wins, then the entry of the
    larger hash, so replays agree; of equal entries one stays.
    """
    columns = [F.col(f"`{c}`") for c in log.columns]
    plain = [F.to_json(F.struct(c)) if isinstance(log.schema[n].dataType, T.VariantType) else c for n, c in zip(log.columns, columns)]
    gone = (F.col("op") == DELETE).cast("long") if "op" in log.columns else F.lit(0).cast("long")
    key = F.shiftleft(F.coalesce(gone, F.lit(0).cast("long")), 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*plain), 2))
    keyed = log.select(*columns, key.alias("_key"))
    at = F.col(f"`{version}`")
    each = keyed.groupBy(F.col(id_col).alias("_id"), at.alias("_at")).agg(F.max("_key").alias("_best"))
    last = each.groupBy("_id").agg(F.max("_at").alias("_last"), F.max_by("_best", "_at").alias("_most"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & at.eqNullSafe(F.col("_last")) & (F.col("_key") == F.col("_most"))
    found = keyed.join(last, same, "left_semi")
    one = Window.partitionBy(id_col, at, "_key").orderBy(F.lit(0))
    return found.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select(*columns)


def live(log: DataFrame, **how) -> DataFrame:
    """Rows that exist now: the last entry of each id unless it is a delete."""
    return latest(log, **how).where(F.col("op") != DELETE)


def replay_after(log: DataFrame, version: int | Column) -> DataFrame:
    """Entries newer than a version."""
    return log.where(F.col("version") > version)


def without(vectors: DataFrame, deleted: DataFrame, *, id_col: str = "vector_id") -> DataFrame:
    """Vectors minus a set of deleted ids."""
    return vectors.join(deleted.select(id_col), id_col, "left_anti")


def existed(vectors: DataFrame, asked: DataFrame, *, id_col: str = "vector_id") -> DataFrame:
    """id, existed: what a delete of each asked id would return."""
    have = vectors.select(F.col(id_col).alias("_have")).distinct()
    return asked.select(id_col).join(have, F.col(id_col) == F.col("_have"), "left").select(id_col, F.col("_have").isNotNull().alias("existed"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of each partition's newest snapshot; ``snapshot_version`` tells them apart."""
    newest = snapshots.groupBy("partition_id").agg(F.max("snapshot_version").alias("snapshot_version"))
    return snapshots.join(newest, ["partition_id", "snapshot_version"], "left_semi")


def recovered(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """State after a crash: the newest snapshot of each partition plus the log's entries after it.

    ``snapshots`` has the log's columns and snapshot_version.  A snapshot at
    version v holds every entry up to v, so entries of v or less are in it.
    """
    base = latest_snapshot(snapshots)
    cut = snapshots.groupBy("partition_id").agg(F.max("snapshot_version").alias("_cut"))
    tail = log.join(cut, "partition_id", "left").where(F.coalesce("_cut", F.lit(-1)) < F.col("version")).select(*log.columns)
    return live(base.select(*log.columns).unionByName(tail))


def compacted(snapshots: DataFrame | None, log: DataFrame) -> DataFrame:
    """A new snapshot: each partition's live rows under the highest version seen in it, tombstones gone."""
    everything = log if snapshots is None else latest_snapshot(snapshots).select(*log.columns).unionByName(log)
    reached = everything.groupBy("partition_id").agg(F.max("version").alias("snapshot_version"))
    return live(everything).join(reached, "partition_id")


def due_for_compaction(log: DataFrame, snapshots: DataFrame | None, interval: int = 1000) -> DataFrame:
    """partition_id, entries of partitions with ``interval`` entries or more after their newest snapshot."""
    if snapshots is not None:
        cut = snapshots.groupBy("partition_id").agg(F.max("snapshot_version").alias("_cut"))
        log = log.join(cut, "partition_id", "left").where(F.coalesce("_cut", F.lit(-1)) < F.col("version"))
    return log.groupBy("partition_id").agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") >= interval)


def export_partition(state: DataFrame, log: DataFrame, partition_id: int) -> DataFrame:
    """The partition's live rows with its version in every row; none for an empty or unknown partition."""
    reached = log.where(F.col("partition_id") == partition_id).agg(F.coalesce(F.max("version"), F.lit(0).cast("long")).alias("partition_version"))
    return state.where(F.col("partition_id") == partition_id).join(F.broadcast(reached))


def partition_version(log: DataFrame, partition_id: int) -> int:
    return log.where(F.col("partition_id") == partition_id).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
