"""A collection's tables in a folder: log segments and snapshots.

* ``log/seg=N`` holds one append each, written by one atomic job.
* ``versions/seg=N`` holds each partition's version after segment N: a row a
  partition, so that an append needs no look at the data.
* ``snapshot/upto=N`` holds the live rows after segments 1 to N, one for each
  id, tombstoned ids gone.

A reader takes the newest snapshot as it is, without the rows that the log
after it has written anew, and only that log is replayed.

A directory counts once its job's ``_SUCCESS`` is there, so a crash in the
middle of a write leaves nothing half visible, and a snapshot always has every
entry of the segments it replaces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import live


class Store:
    """Segments and snapshots of one collection; a single writer, any readers."""

    def __init__(self, spark: SparkSession, path: str, metadata: T.DataType):
        self.spark, self.path, self.metadata = spark, path.rstrip("/"), metadata

    def schema(self) -> T.StructType:
        return T.StructType([
            T.StructField("partition_id", T.IntegerType()), T.StructField("version", T.LongType()), T.StructField("op", T.StringType()),
            T.StructField("vector_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", self.metadata),
        ])

    def _done(self, kind: str, key: str) -> list[int]:
        """Numbers of the finished directories of a kind, ascending."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for s in fs.listStatus(root):
            m = re.fullmatch(rf"{key}=(\d+)", s.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append(int(m[1]))
        return sorted(found)

    def segments(self) -> list[int]:
        return self._done("log", "seg")

    def snapshots(self) -> list[int]:
        return self._done("snapshot", "upto")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(*paths)

    def append(self, rows: DataFrame) -> int:
        """Write rows of the log's schema as the next segment; returns its number."""
        n = max([0, *self.segments(), *self.snapshots()]) + 1
        rows.select(*self.schema().names).write.mode("overwrite").parquet(f"{self.path}/log/seg={n}")
        self.versions().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/seg={n}")
        return n

    def log(self, after: int = 0) -> DataFrame:
        """Entries of the segments after a number."""
        return self._read([f"{self.path}/log/seg={n}" for n in self.segments() if n > after])

    def _base(self) -> tuple[int, DataFrame]:
        done = self.snapshots()
        upto = done[-1] if done else 0
        return upto, self._read([f"{self.path}/snapshot/upto={upto}"] if done else [])

    def entries(self) -> DataFrame:
        """The newest snapshot's rows and the log after it."""
        upto, base = self._base()
        return base.unionByName(self.log(upto))

    def state(self) -> DataFrame:
        """Live rows: what a reader sees, and what a restart recovers."""
        upto, base = self._base()
        if not [n for n in self.segments() if n > upto]:
            return base
        tail = self.log(upto)
        kept = base.join(tail.select("vector_id"), "vector_id", "left_anti").select(*self.schema().names)
        return kept.unionByName(live(tail))

    def versions(self) -> DataFrame:
        """partition_id, version reached: the newest finished table, and the log that a crash left after it."""
        done = self._done("versions", "seg")
        known = done[-1] if done else 0
        later = self.log(known).groupBy("partition_id").agg(F.max("version").alias("version"))
        if not done:
            return later
        table = self.spark.read.schema("partition_id int, version long").parquet(f"{self.path}/versions/seg={known}")
        return table.unionByName(later).groupBy("partition_id").agg(F.max("version").alias("version"))

    def entries_since_snapshot(self) -> int:
        return self.log(self._base()[0]).count()

    def compact(self) -> int | None:
        """Write a snapshot of everything so far; earlier directories are then removed.  Returns its number."""
        segments = self.segments()
        upto = max(segments, default=0)
        if not segments or upto in self.snapshots():
            return None
        # ranges of (partition, id): a partition of any size is split, and files stay of one size
        self.state().repartitionByRange("partition_id", "vector_id").sortWithinPartitions("partition_id", "vector_id").write.mode("overwrite").parquet(f"{self.path}/snapshot/upto={upto}")
        if upto not in self._done("versions", "seg"):
            self.versions().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/seg={upto}")
        self._remove(upto)
        return upto

    def drop(self, names: list[str]) -> None:
        """Delete directories of the store."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _remove(self, upto: int) -> None:
        old = [f"log/seg={n}" for n in self.segments() if n <= upto] + [f"snapshot/upto={n}" for n in self.snapshots() if n < upto]
        self.drop(old + [f"versions/seg={n}" for n in self._done("versions", "seg")[:-1]])
