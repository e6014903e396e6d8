"""A collection of vectors with metadata: upsert, get, delete, search, statistics."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.distance import as_vector, check_metric, distance, literal_norm
from .functions.hashing import PARTITIONS, partition_of, partition_of_id
from .functions.predicates import apply_filter, compile_filter
from .operators import ann, knn, ring, stats
from .operators.changes import DELETE, INSERT, live
from .sources.store import Store
from .workspace import scope, stored


#: Numbers (rows times dimensions) that the driver may hold: 128 MB.
LOCAL_CELLS = 1 << 24


class Collection:
    """``with Collection(spark, path, dim=128) as c: c.put("a", [...], {"year": 2020})``

    Metadata is free-form (VARIANT) unless ``metadata`` gives a struct type,
    which filters then push into the scan.  ``nodes`` names the owners that
    size and ring statistics are reported for; storage and execution are
    Spark's.  After every ``snapshot_interval`` log entries an append also
    compacts.

    ``strategy`` is exact, lsh, hnsw, or auto: exact up to ``ann.EXACT_ROWS``
    rows and graphs beyond.  Graphs are kept by partition with the version that
    they reach; what was written since is searched exactly and merged.

    A collection of up to LOCAL_CELLS numbers that is asked again without a
    write between is held on the driver, and single queries are answered
    there with the same arithmetic; a filtered query, and one to a larger
    collection, is a Spark job.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int = 128, *, metric: str = "cosine", num_partitions: int = PARTITIONS, backup_count: int = 1,
                 nodes: Iterable[str] = ("node-0",), metadata: T.StructType | None = None, snapshot_interval: int = 1000, strategy: str = "auto"):
        if dim < 1:
            raise ValueError("dim must be 1 or more")
        self.spark, self.dim, self.metric = spark, dim, check_metric(metric)
        self.num_partitions, self.backup_count, self.nodes = num_partitions, backup_count, sorted(set(nodes))
        self.metadata, self.snapshot_interval, self.strategy = metadata, snapshot_interval, ann.check_strategy(strategy)
        self.store = Store(spark, path, metadata or T.VariantType())
        # graphs, the version that each partition's reach, and the snapshot of rows held on the driver
        self._graphs: DataFrame | None = None
        self._reached: dict[int, int] = {}
        self._asked: Any = None
        self._auto: tuple[Any, str] | None = None
        self._held: tuple[Any, ...] | None = None
        self._pending = self.store.entries_since_snapshot() if self.store.segments() else 0

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def close(self) -> None:
        """Compact what is in the log."""
        if self._pending:
            self.compact()

    # writes

    def _numbered(self, placed: DataFrame, few: bool) -> DataFrame:
        """The rows with their version: their place within their partition, by order and id, after what it has.

        Rows are sorted in ranges of (partition, order, id, vector), so a
        partition of any size is many tasks'; a row a range and partition says
        where its places begin.  A few rows get the same places from a window.
        """
        reached = self.store.versions().select(F.col("partition_id").alias("_p"), F.col("version").alias("_at"))
        order = ("partition_id", "_order", "vector_id", "_tie")
        placed = placed.withColumn("_tie", F.xxhash64("embedding"))
        at = F.coalesce("_at", F.lit(0)).cast("long")
        if few:
            place = F.row_number().over(Window.partitionBy("partition_id").orderBy(*order[1:]))
            return placed.join(reached, F.col("partition_id").eqNullSafe(F.col("_p")), "left").withColumn("version", at + place)
        ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged = stored(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_n")), "ranged")
        # no more rows than ranges and partitions together
        starts = ranged.groupBy("partition_id", "_range").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        before = Window.partitionBy("partition_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.join(reached, F.col("partition_id").eqNullSafe(F.col("_p")), "left")
        starts = starts.select(F.col("partition_id").alias("_s"), F.col("_range").alias("_r"), (at + F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_begin"))
        same = F.col("partition_id").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
        return ranged.join(F.broadcast(starts), same).withColumn("version", F.col("_begin") + F.col("_n"))

    def _append(self, rows: DataFrame, op: str, few: bool = False) -> int:
        """Number the rows within their partitions, after what these have, and write them as a segment."""
        placed = rows.withColumn("partition_id", partition_of(F.col("vector_id"), self.num_partitions))
        with scope(self.spark):
            n = self.store.append(self._numbered(placed, few).withColumn("op", F.lit(op)))
        written = self.store._read([f"{self.store.path}/log/seg={n}"]).count()
        self._pending += written
        if self._pending >= self.snapshot_interval:
            self.compact()
        return written

    def _meta(self, rows: DataFrame) -> DataFrame:
        kind = rows.schema["metadata"].dataType if "metadata" in rows.columns else None
        if kind is None:
            empty = F.parse_json(F.lit("{}")) if self.metadata is None else F.lit(None).cast(self.metadata)
            return rows.withColumn("metadata", empty)
        if self.metadata is None and isinstance(kind, T.StringType):
            return rows.withColumn("metadata", F.parse_json(F.coalesce("metadata", F.lit("{}"))))
        if self.metadata is None and not isinstance(kind, T.VariantType):
            return rows.withColumn("metadata", F.to_variant_object("metadata"))
        return rows

    def put_many(self, rows: DataFrame, order: str | None = None) -> int:
        """Upsert rows of (vector_id, embedding[, metadata]); of an id's rows the last by ``order`` wins.

        Metadata is replaced, never merged.  A vector of another length than
        ``dim`` fails the job, and nothing is written.  Returns the number of
        entries.
        """
        return self._append(self._body(rows, order), INSERT)

    def _body(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        body = self._meta(rows).withColumn("_order", F.col(order) if order else F.lit(0))
        return knn.checked(body.select(F.col("vector_id").cast("string"), F.col("embedding").cast("array<float>"), "metadata", "_order"), self.dim)

    def put(self, vector_id: str, vector: Sequence[float], metadata: dict | None = None) -> None:
        """Upsert one vector."""
        values = [float(x) for x in vector]
        if len(values) != self.dim:
            raise ValueError(f"vector of length {len(values)}, not {self.dim}")
        if self.metadata is None:
            row, kind = json.dumps(metadata or {}), "string"
            df = self.spark.createDataFrame([(vector_id, values, row)], f"vector_id string, embedding array<float>, metadata {kind}")
        else:
            row = tuple((metadata or {}).get(n) for n in self.metadata.names)
            df = self.spark.createDataFrame([(vector_id, values, row)], T.StructType([T.StructField("vector_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", self.metadata)]))
        self._append(self._body(df), INSERT, few=True)

    def delete_many(self, ids: DataFrame) -> int:
        """Delete the ids (column vector_id) that exist; returns how many did."""
        return self._append(self._gone(ids), DELETE)

    def _gone(self, ids: DataFrame) -> DataFrame:
        """Tombstones of the ids that exist."""
        asked = ids.select(F.col("vector_id").cast("string")).distinct()
        gone = live(self.store.entries().join(asked, "vector_id", "left_semi"))
        return gone.select("vector_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast(self.store.metadata).alias("metadata"), F.lit(0).alias("_order"))

    def delete(self, vector_id: str) -> bool:
        """Whether the id existed; it doesn't any more."""
        if self.get(vector_id) is None:
            return False
        return self._append(self._gone(self.spark.createDataFrame([(vector_id,)], "vector_id string")), DELETE, few=True) == 1

    def compact(self) -> int | None:
        """Fold the log into a snapshot."""
        self._pending = 0
        return self.store.compact()

    # reads

    def scan(self) -> DataFrame:
        """vector_id, embedding, metadata, partition_id, version of live rows."""
        return self.store.state().select("vector_id", "embedding", "metadata", "partition_id", "version")

    def get(self, vector_id: str) -> tuple[list[float], dict | None] | None:
        """(vector, metadata) of an id, or None.  The id's partition is computed here, so row groups of others are skipped."""
        pid = partition_of_id(vector_id, self.num_partitions)
        mine = self.store.entries().where((F.col("partition_id") == pid) & (F.col("vector_id") == vector_id))
        best = mine.agg(F.max_by(F.struct("op", "embedding", F.to_json("metadata").alias("m") if self.metadata is not None else F.col("metadata").cast("string").alias("m")), "version")).first()[0]
        if best is None or best["op"] == DELETE:
            return None
        return list(best["embedding"]), json.loads(best["m"]) if best["m"] else {}

    def contains(self, vector_id: str) -> bool:
        return self.get(vector_id) is not None

    def _check(self, query: Sequence[float], k: int) -> None:
        if len(query) != self.dim:
            raise ValueError(f"query of length {len(query)}, not {self.dim}")
        knn.check_k(k)

    def _mark(self) -> tuple:
        """What tells one state of the store from another."""
        return tuple(self.store.segments()), tuple(self.store.snapshots())

    def _local(self) -> tuple[Any, ...] | None:
        """Ids, vectors, partitions and metadata (as JSON) of a small collection that is asked again in the same state."""
        mark = self._mark()
        if self._held is not None and self._held[0] == mark:
            return self._held if len(self._held) > 1 else None
        if self._asked != mark:
            self._asked = mark
            return None
        rows = self.scan()
        self._held = (mark,)
        if rows.limit(LOCAL_CELLS // self.dim + 1).count() > LOCAL_CELLS // self.dim:
            return None
        text = F.to_json("metadata")
        # metadata comes back from JSON: only where that gives the same values (1.0 may come back as 1)
        back = F.parse_json(text) if self.metadata is None else F.from_json(text, self.metadata)
        shape = lambda m: F.regexp_replace(F.schema_of_variant(m), r"BIGINT|DECIMAL\([0-9]+,[0-9]+\)", "NUMBER")
        same = shape(F.col("metadata")).eqNullSafe(shape(back)) if self.metadata is None else F.col("metadata").eqNullSafe(back)
        got = rows.where("embedding is not null").select("vector_id", "embedding", "partition_id", text.alias("m"), same.alias("same")).toArrow()
        if got.num_rows and not all(got["same"].to_pylist()):
            return None
        got = got.sort_by("vector_id")
        flat = got["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0)
        self._held = mark, np.array(got["vector_id"].to_pylist(), object), flat.reshape(-1, self.dim).astype(np.float64), got["partition_id"].to_pylist(), got["m"].to_pylist()
        return self._held

    def _search_local(self, held: tuple[Any, ...], query: Sequence[float], k: int) -> DataFrame:
        _, ids, x, parts, meta = held
        q = np.asarray(query, np.float32).astype(np.float64)[None]
        # rows are held in the order of their ids
        _, dist, at = knn.block_nearest(x, np.arange(len(ids)), q, k, self.metric) if len(ids) else (None, np.zeros(0), np.zeros(0, np.int64))
        owners = [self.nodes[parts[i] % len(self.nodes)] if self.nodes else None for i in at]
        table = pa.table({"vector_id": pa.array(ids[at].tolist(), pa.string()), "distance": pa.array(dist), "m": pa.array([meta[i] for i in at], pa.string()), "partition_id": pa.array([parts[i] for i in at], pa.int32()), "source_node": pa.array(owners, pa.string())})
        back = F.parse_json("m") if self.metadata is None else F.from_json("m", self.metadata)
        return self.spark.createDataFrame(table).select("vector_id", "distance", back.alias("metadata"), "partition_id", "source_node")

    def _strategy(self) -> str:
        if self.strategy != "auto":
            return self.strategy
        mark = self._mark()
        if self._auto is None or self._auto[0] != mark:
            self._auto = mark, "exact" if self.store.state().limit(ann.EXACT_ROWS + 1).count() <= ann.EXACT_ROWS else "hnsw"
        return self._auto[1]

    def search(self, query: Sequence[float], k: int = 10, *, where: Any = None, ef: int | None = None) -> DataFrame:
        """The k nearest live rows: vector_id, distance, metadata, partition_id, source_node.

        A filter is applied before the k nearest are chosen, whatever the
        strategy.
        """
        self._check(query, k)
        held = self._local() if where is None and self.strategy in ("auto", "exact") else None
        if held is not None:
            return self._search_local(held, query, k)
        rows = self.scan()
        compile_filter(where, rows)
        if self._strategy() in ("lsh", "hnsw"):
            one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<float>")
            found = self.search_batch(one, k, where=where, ef=ef).drop("query_id", "rank")
            near = found.join(rows.select("vector_id", "metadata", "partition_id"), "vector_id")
        else:
            near = apply_filter(rows, where).select("vector_id", distance(F.col("embedding"), as_vector(query), self.metric, literal_norm(query)).alias("distance"), "metadata", "partition_id")
        return near.withColumn("source_node", ring.owner_of(F.col("partition_id"), self.nodes)).orderBy("distance", "vector_id").limit(k)

    def search_batch(self, queries: DataFrame, k: int = 10, *, where: Any = None, ef: int | None = None) -> DataFrame:
        """query_id, vector_id, distance, rank for queries of (query_id, embedding)."""
        rows, strategy = self.scan(), self._strategy()
        if strategy == "lsh":
            return ann.search_lsh(rows, queries, k, self.dim, metric=self.metric, where=where, metadata="metadata")
        if strategy == "hnsw":
            return self._search_graphs(queries, k, where, ef)
        return knn.search_matrix(rows, queries, k, metric=self.metric, where=where, metadata="metadata")

    def _search_graphs(self, queries: DataFrame, k: int, where: Any, ef: int | None) -> DataFrame:
        graphs = self.graphs()
        changed = [p for p, v in self._versions().items() if v > self._reached.get(p, 0)]
        if not changed and where is None:
            return ann.search_graphs(graphs, queries, k, metric=self.metric, ef=ef)
        # a row a partition
        reached = F.broadcast(self.spark.createDataFrame([(-1, 0), *self._reached.items()], "_p int, _upto long"))
        rows = apply_filter(self.scan(), where, "metadata").join(reached, F.col("partition_id") == F.col("_p"), "left")
        old = F.col("version") <= F.coalesce("_upto", F.lit(0))
        allowed = rows.where(old).select("vector_id", F.col("partition_id").alias("part"))
        if where is None:
            allowed = allowed.where(F.col("part").isin(changed))
        found = ann.search_graphs(graphs, queries, k, metric=self.metric, ef=ef, allowed=allowed, limited=changed if where is None else None)
        fresh = knn.search_matrix(rows.where(~old), queries, k, metric=self.metric)
        return knn._top(found.drop("rank").unionByName(fresh.drop("rank")), ["query_id"], k, "vector_id")

    def _versions(self) -> dict[int, int]:
        """The version of each partition that has one: a row a partition."""
        return {r["partition_id"]: r["version"] for r in self.store.versions().collect()}

    def graphs(self) -> DataFrame:
        """The graphs, by partition, built once and kept in the shared folder; see ``rebuild_partition``."""
        if self._graphs is None:
            reached = self._versions()
            self._graphs, self._reached = stored(ann.build_graphs(self.scan(), metric=self.metric, by="partition_id"), "graphs"), reached
        return self._graphs

    # statistics and administration

    def size(self) -> int:
        return self.store.state().count()

    def local_size(self, node: str) -> int:
        return self.stats().where(F.col("node") == node).agg(F.coalesce(F.sum("primary_vectors"), F.lit(0))).first()[0]

    def local_backup_size(self, node: str) -> int:
        return self.stats().where(F.col("node") == node).agg(F.coalesce(F.sum("backup_vectors"), F.lit(0))).first()[0]

    def stats(self) -> DataFrame:
        """Partitions and vectors of each node by role."""
        return stats.sizes_by_node(self.store.state(), self.nodes, num_partitions=self.num_partitions, backup_count=self.backup_count)

    def partition_ids(self) -> DataFrame:
        return ring.partition_ids(self.spark, self.num_partitions)

    def node_partitions(self, node: str, role: str = "primary") -> DataFrame:
        return ring.node_partitions(self.spark, self.nodes, node, role=role, num_partitions=self.num_partitions, backup_count=self.backup_count)

    def export_partition(self, partition_id: int) -> tuple[DataFrame, int]:
        """A partition's live rows and its version; no rows and 0 for an unknown or empty one."""
        version = self.store.versions().where(F.col("partition_id") == partition_id).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        return self.scan().where(F.col("partition_id") == partition_id), version

    def rebuild_partition(self, partition_id: int) -> bool:
        """Build the partition's graphs anew from its live rows, if graphs are in use; False for a partition that doesn't exist or has no owner.

        Other partitions' graphs stay.  Writes that come meanwhile have higher
        versions than the one noted before, and are searched exactly.
        """
        if not 0 <= partition_id < self.num_partitions or not self.nodes:
            return False
        if self._graphs is not None:
            version = self._versions().get(partition_id, 0)
            own = stored(ann.build_graphs(self.scan().where(F.col("partition_id") == partition_id), metric=self.metric, by="partition_id"), "graphs")
            self._graphs = self._graphs.where(F.col("part") != partition_id).unionByName(own)
            self._reached = {**self._reached, partition_id: version}
        return True

    def remove_partition(self, partition_id: int) -> int:
        """Delete all rows of a partition; returns their number.  Its version goes on."""
        rows = self.store.state().where(F.col("partition_id") == partition_id).select("vector_id")
        return self.delete_many(rows) if not rows.isEmpty() else 0
