"""Registered queries of the vector engine and the SQL that checks them.

Tables: ``embeddings`` are the vectors, with metadata from ``documents`` and
``labels`` by id; ``events`` is a change log (user = id, event_id = version,
type ``error`` = delete) and a stream of beats.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions.distance import as_vector, distance
from ..functions.hashing import partition_of, partition_of_id
from ..functions.predicates import apply_filter
from ..operators import ann, changes, knn, ring, stats
from ..sources import binlog
from ..streaming.ingest import ingest
from ..workspace import fresh_path, stored

K = 10
#: Every so many ids asks for its neighbours, against all rows.
EACH = 20
NODES = ("n-0", "n-1", "n-2")
DIGITS = 6


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _is_asked() -> Column:
    """The query set: every id that EACH divides."""
    return F.col("vec_id") % EACH == 0


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).where(_is_asked()).select(F.col("vec_id").alias("query_id"), "embedding")


def _first(spark: SparkSession, d: str) -> list[float]:
    return _embeddings(spark, d).where("vec_id = 0").first()["embedding"]


def _with_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("l_id"), "quality")
    e = _embeddings(spark, d)
    joined = e.join(docs, e["vec_id"] == docs["doc_id"], "left").join(labels, e["vec_id"] == labels["l_id"], "left")
    return joined.select("vec_id", "embedding", "label", F.struct("lang", "source", "n_chars", "quality").alias("metadata"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", DIGITS))


def _knn(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(knn.search_by_id(_embeddings(spark, d), 0, K, metric=metric, id_col="vec_id"))

    return query


def _filtered(spec, variant: bool = False):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _with_metadata(spark, d)
        if variant:
            rows = rows.withColumn("metadata", F.to_variant_object("metadata"))
        return _rounded(knn.search(rows, _first(spark, d), K, id_col="vec_id", where=spec, metadata="metadata"))

    return query


def _matching(spec):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return apply_filter(_with_metadata(spark, d), spec).select("vec_id")

    return query


def _batch(metric: str = "cosine"):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(knn.search_batch(_embeddings(spark, d), _queries(spark, d), K, metric=metric, id_col="vec_id"))

    return query


def _batch_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The batch with its queries and vectors meeting in a join, as beyond what may be broadcast."""
    e, q = _embeddings(spark, d), _queries(spark, d)
    bound, knn.BROADCAST_BYTES = knn.BROADCAST_BYTES, 8 * len(_first(spark, d)) * 16
    try:
        return _rounded(knn.search_batch(e, q, K, id_col="vec_id"))
    finally:
        knn.BROADCAST_BYTES = bound


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).select("vec_id", partition_of(F.col("vec_id")).alias("partition_id"))


def _per_partition(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knn.search_partitions(_embeddings(spark, d), as_vector(_first(spark, d)), 1, id_col="vec_id"))


def _scatter(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knn.scatter_gather(_embeddings(spark, d), as_vector(_first(spark, d)), NODES, K, id_col="vec_id"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a change log."""
    e = _events(spark, d)
    gone = F.col("event_type") == "error"
    return e.select(
        partition_of(F.col("user_id")).alias("partition_id"), F.col("event_id").alias("version"), F.when(gone, changes.DELETE).otherwise(changes.INSERT).alias("op"),
        F.col("user_id").cast("string").alias("vector_id"), F.when(~gone, F.array(F.col("value").cast("float"))).alias("embedding"),
        F.when(~gone, F.col("props")).alias("metadata"))


def _snapshots(spark: SparkSession, d: str, shares: tuple[float, ...]) -> DataFrame:
    """Snapshots of the log after given shares of all its versions."""
    log = _log(spark, d)
    top = _events(spark, d).agg(F.max("event_id")).first()[0]
    out = None
    for s in shares:
        cut = int(math.floor(top * s))
        one = changes.compacted(None, log.where(F.col("version") <= cut)).withColumn("snapshot_version", F.lit(cut).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def _state(df: DataFrame) -> DataFrame:
    return df.select("vector_id", "version", "partition_id", F.round(F.element_at("embedding", 1).cast("double"), 3).alias("value"))


def _snapshot_tail(spark: SparkSession, d: str) -> DataFrame:
    return _state(changes.recovered(_snapshots(spark, d, (0.4, 0.7)), _log(spark, d)))


def _exported(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    pid = log.agg(F.min("partition_id")).first()[0]
    return changes.export_partition(changes.live(log), log, pid).select("vector_id", "version", "partition_id", "partition_version")


def _exists(spark: SparkSession, d: str) -> DataFrame:
    """Every id that EACH divides, and as many beyond the largest."""
    e = _embeddings(spark, d)
    mine = e.where(_is_asked()).select("vec_id")
    asked = mine.unionByName(mine.crossJoin(F.broadcast(e.agg(F.max("vec_id").alias("top")))).select((F.col("vec_id") + F.col("top") + 1).alias("vec_id")))
    return changes.existed(e, asked, id_col="vec_id")


def _deleted(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return changes.without(e, e.where("label = 3"), id_col="vec_id").select("vec_id", "label")


def _held_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of the copies that two nodes hold after a third has joined."""
    before = stats.partition_counts(_placed(spark, d)).join(ring.ring(spark, NODES[:2]), "partition_id")
    held = before.select(F.col("owner").alias("node"), "partition_id", "vectors").unionByName(before.select(F.explode("backups").alias("node"), "partition_id", "vectors"))
    return ring.held_roles(held, NODES)


def _get(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).where("vec_id = 7").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


def _recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of searching each vector's own label only, against all rows."""
    e, q = _embeddings(spark, d), _embeddings(spark, d).where(_is_asked())
    exact = knn.search_batch(e, _queries(spark, d), K, id_col="vec_id")
    near = e.join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), F.col("label")), "label")
    near = near.select("query_id", "vec_id", distance(F.col("embedding"), F.col("_q")).alias("distance"))
    found = knn._top(near, ["query_id"], K, "vec_id")
    return knn.recall_at_k(exact, found, K, id_col="vec_id").select("query_id", F.round("recall", DIGITS).alias("recall"))


def _latency(spark: SparkSession, d: str) -> DataFrame:
    s = knn.latency_stats(_events(spark, d).where("value > 0"), "value")
    return s.select(*[F.round(c, 3).alias(c) for c in s.columns])


def _dim(spark: SparkSession, d: str) -> int:
    return len(_first(spark, d))


def _lsh(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ann.search_lsh(_embeddings(spark, d), _queries(spark, d), K, _dim(spark, d), id_col="vec_id"))


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    return ann.build_graphs(_embeddings(spark, d), id_col="vec_id")


def _hnsw(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ann.search_graphs(_graphs(spark, d), _queries(spark, d), K, id_col="vec_id", ef=100))


def _is_odd() -> Column:
    return F.col("label") % 2 == 1


def _lsh_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ann.search_lsh(_embeddings(spark, d).where(_is_odd()), _queries(spark, d), K, _dim(spark, d), id_col="vec_id"))


def _hnsw_filtered(spark: SparkSession, d: str) -> DataFrame:
    allowed = _embeddings(spark, d).where(_is_odd()).select("vec_id", F.lit(0).alias("part"))
    return _rounded(ann.search_graphs(_graphs(spark, d), _queries(spark, d), K, id_col="vec_id", ef=100, allowed=allowed))


def _ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at k of both approximate strategies over the whole query set, without and with a filter."""
    e, q, out = _embeddings(spark, d), _queries(spark, d), None
    for rows, strategies in ((e, (("lsh", _lsh), ("hnsw", _hnsw))), (e.where(_is_odd()), (("lsh filtered", _lsh_filtered), ("hnsw filtered", _hnsw_filtered)))):
        exact = stored(knn.search_matrix(rows, q, K, id_col="vec_id"), "exact")
        for name, find in strategies:
            one = knn.recall_at_k(exact, find(spark, d), K, id_col="vec_id").agg(F.avg("recall").alias("recall")).select(F.lit(name).alias("strategy"), "recall")
            out = one if out is None else out.unionByName(one)
    return out


def _ann_reached(spark: SparkSession, d: str) -> DataFrame:
    """Whether each strategy's recall is 0.9 or more."""
    return _ann_recall(spark, d).select("strategy", (F.col("recall") >= 0.9).alias("reached"))


def _log_files(spark: SparkSession, d: str) -> DataFrame:
    """The log written to binary files and read back, then replayed."""
    folder = fresh_path(spark, "log-files")
    binlog.write_logs(_log(spark, d), folder)
    return _state(changes.live(binlog.read_logs(spark, folder)))


def _snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of each partition written to binary files; the newest of each is read back."""
    folder = fresh_path(spark, "snapshot-files")
    for share in (0.4, 0.7):
        binlog.write_snapshots(_snapshots(spark, d, (share,)), folder)
    got = binlog.read_snapshots(spark, folder)
    return got.select("vector_id", "partition_id", "snapshot_version", F.round(F.element_at("embedding", 1).cast("double"), 3).alias("value"))


def _collection(spark: SparkSession, d: str) -> Collection:
    e = _with_metadata(spark, d)
    c = Collection(spark, fresh_path(spark, "collection"), dim=_dim(spark, d), nodes=NODES, metadata=e.schema["metadata"].dataType, snapshot_interval=10**9)
    c.put_many(e.select(F.col("vec_id").cast("string").alias("vector_id"), "embedding", "metadata"))
    return c


def _collection_search(spark: SparkSession, d: str) -> DataFrame:
    c = _collection(spark, d)
    c.delete_many(spark.range(20, 40).select(F.col("id").cast("string").alias("vector_id")))
    c.compact()
    got = c.search(_first(spark, d), K, where={"field": "lang", "op": "ne", "value": "en"})
    return _rounded(got.select(F.col("vector_id").cast("long").alias("vec_id"), "distance", "partition_id", "source_node"))


def _collection_writes(spark: SparkSession, d: str) -> DataFrame:
    """Every 20th row put anew with its vector turned round, every 30th deleted; what is there then."""
    c, e = _collection(spark, d), _with_metadata(spark, d)
    name = F.col("vec_id").cast("string").alias("vector_id")
    c.put_many(e.where(_is_asked()).select(name, F.transform("embedding", lambda x: -x).alias("embedding"), "metadata"))
    c.delete_many(e.where("vec_id % 30 = 0").select(name))
    return c.scan().select(F.col("vector_id").cast("long").alias("vec_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), DIGITS).alias("x"))


def _collection_get(spark: SparkSession, d: str) -> DataFrame:
    """Three ids by ``Collection.get``, one of them deleted before and one unknown."""
    c = _collection(spark, d)
    c.delete("7")
    got = [(i, v is not None, 0 if v is None else len(v[0])) for i in ("5", "7", "none") for v in (c.get(i),)]
    return spark.createDataFrame(got, "vector_id string, found boolean, dim int")


def _collection_remove(spark: SparkSession, d: str) -> DataFrame:
    """Rows left by partition when the partition of id 0 is removed."""
    c = _collection(spark, d)
    c.remove_partition(partition_of_id("0"))
    return c.scan().groupBy("partition_id").agg(F.count(F.lit(1)).alias("vectors"))


def _collection_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Graph search finds rows written after the graphs, not those deleted, before and after one partition is rebuilt."""
    e = _with_metadata(spark, d)
    c = Collection(spark, fresh_path(spark, "collection"), dim=_dim(spark, d), num_partitions=3, nodes=NODES, metadata=e.schema["metadata"].dataType, snapshot_interval=10**9, strategy="hnsw")
    rows = e.select(F.col("vec_id").cast("string").alias("vector_id"), "embedding", "metadata")
    c.put_many(rows.where("cast(vector_id as long) % 40 <> 0"))
    c.graphs()
    c.put_many(rows.where("cast(vector_id as long) % 40 = 0"))
    c.delete_many(rows.where("cast(vector_id as long) % 40 = 20").select("vector_id"))
    out = None
    for step in ("written", "rebuilt"):
        if step == "rebuilt":
            c.rebuild_partition(partition_of_id("0", 3))
        found = c.search_batch(_queries(spark, d), 1).select(F.lit(step).alias("step"), "query_id", (F.col("vector_id").cast("long") == F.col("query_id")).alias("itself"))
        out = found if out is None else out.unionByName(found)
    return out


def _storage(spark: SparkSession, d: str) -> DataFrame:
    """Files of a written log and of two snapshots of each partition."""
    folder = fresh_path(spark, "storage")
    binlog.write_logs(_log(spark, d), folder)
    for share in (0.4, 0.7):
        binlog.write_snapshots(_snapshots(spark, d, (share,)), folder)
    return binlog.storage_stats(spark, folder).select("log_files", "snapshot_files")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream of several micro-batches into a collection; its state is the batch result."""
    source, base = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-collection")
    log = _log(spark, d)
    log.repartition(3, F.xxhash64("version")).write.parquet(source)
    c = Collection(spark, base, dim=1, snapshot_interval=10**9)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest(stream, c, f"{base}-checkpoint").awaitTermination()
    return c.scan().select("vector_id", "partition_id", F.round(F.element_at("embedding", 1).cast("double"), 3).alias("value"))


ADD, REMOVE = "n-9", "n-1"

#: SQL pieces.
_PID = ("list_reduce(list_prepend(0::BIGINT, [('0x' || substr(sha256({0}::VARCHAR), i * 8 + 1, 8))::BIGINT for i in range(8)]), "
        f"lambda a, b: (a * {(1 << 32) % 271} + b) % 271)::INTEGER")
_V, _Q = "e.embedding::DOUBLE[]", "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DIST = {"cosine": "list_cosine_distance({0}, {1})", "euclidean": "list_distance({0}, {1})", "dot": "-list_inner_product({0}, {1})"}
_META = "(SELECT e.vec_id, e.embedding, e.label, d.lang, d.source, d.n_chars, l.quality FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id)"
_LOG = f"(SELECT {_PID.format('user_id')} AS partition_id, event_id AS version, event_type = 'error' AS gone, user_id::VARCHAR AS vector_id, value::FLOAT AS value FROM events)"
_TOP = "(SELECT max(event_id) FROM events)"


def _knn_sql(metric: str = "cosine", rows: str = "embeddings", where: str = "true") -> str:
    return f"SELECT vec_id, round(distance, 6) AS distance FROM (SELECT vec_id, {_DIST[metric].format(_V, _Q)} AS distance FROM {rows} e WHERE {where} ORDER BY 2, 1 LIMIT {K})"


#: The query set in SQL.
_ASKED_SQL = f"q.vec_id % {EACH} = 0"


def _batch_sql(metric: str = "cosine") -> str:
    far = _DIST[metric].format(_V, "q.embedding::DOUBLE[]")
    return (f"SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {far} AS distance, "
            f"row_number() OVER (PARTITION BY q.vec_id ORDER BY {far}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE {_ASKED_SQL}) WHERE rank <= {K}")


def _recall_sql() -> str:
    return f"WITH x AS ({_batch_sql()}), y AS (SELECT query_id, vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST['cosine'].format(_V, 'q.embedding::DOUBLE[]')}, e.vec_id) AS k FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE {_ASKED_SQL}) WHERE k <= {K}) SELECT x.query_id, round(count(y.vec_id) / {K}.0::DOUBLE, 6) AS recall FROM x LEFT JOIN y ON x.query_id = y.query_id AND x.vec_id = y.vec_id GROUP BY 1"


def _state_sql(source: str = _LOG, where: str = "true") -> str:
    return (f"SELECT vector_id, version, partition_id, round(value::DOUBLE, 3) AS value FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY version DESC) AS k "
            f"FROM {source} WHERE {where}) WHERE k = 1 AND NOT gone")


def _owner_sql(pid: str, nodes: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in sorted(nodes)) + f"][{pid} % {len(nodes)} + 1]"


_RING = f"(SELECT p::INTEGER AS partition_id, {_owner_sql('p', NODES)} AS owner, {_owner_sql('(p + 1)', NODES)} AS backup FROM range(271) t(p))"
_SIZES = (f"(SELECT r.partition_id, owner, backup, count(e.pid) AS vectors FROM {_RING} r LEFT JOIN (SELECT {_PID.format('vec_id')} AS pid FROM embeddings) e ON e.pid = r.partition_id GROUP BY ALL)")

#: Filters: name -> (specification, SQL condition on the metadata).
FILTERS = {
    "eq": ({"field": "lang", "op": "eq", "value": "en"}, "lang = 'en'"),
    "ne": ({"field": "lang", "op": "ne", "value": "en"}, "lang <> 'en'"),
    "gt": ({"field": "n_chars", "op": "gt", "value": 1500}, "n_chars > 1500"),
    "gte": ({"field": "n_chars", "op": "gte", "value": 1500}, "n_chars >= 1500"),
    "lt": ({"field": "n_chars", "op": "lt", "value": 1500}, "n_chars < 1500"),
    "lte": ({"field": "n_chars", "op": "lte", "value": 1500}, "n_chars <= 1500"),
    "in": ({"field": "lang", "op": "in", "value": ["fr", "de"]}, "lang IN ('fr', 'de')"),
    "and": ([{"field": "lang", "op": "eq", "value": "en"}, {"field": "n_chars", "op": "gt", "value": 1000}], "lang = 'en' AND n_chars > 1000"),
    "none_match": ({"field": "lang", "op": "eq", "value": "xx"}, "lang = 'xx'"),
    "callable": (lambda m: m.get("lang") == "en" and m["n_chars"] % 2 == 0, "lang = 'en' AND n_chars % 2 = 0"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"knn_{m}": _knn(m) for m in ("cosine", "euclidean", "dot")}
    out |= {f"knn_filter_{name}": _filtered(spec) for name, (spec, _) in FILTERS.items()}
    out |= {
        "knn_filter_variant": _filtered(FILTERS["and"][0], variant=True),
        "knn_batch": _batch(),
        "knn_batch_euclidean": _batch("euclidean"),
        "knn_batch_dot": _batch("dot"),
        "knn_batch_grouped": _batch_grouped,
        "knn_per_partition": _per_partition,
        "knn_scatter_gather": _scatter,
        "filter_missing_field": _matching({"field": "quality", "op": "ne", "value": 5}),
        "filter_in_substring": _matching({"field": "source", "op": "in", "value": "src1 and src12"}),
        "filter_ne_null": _matching({"field": "quality", "op": "ne", "value": None}),
        "filter_type_mismatch": _matching({"field": "lang", "op": "ne", "value": 7}),
        "partition_assign": _placed,
        "partition_counts": lambda s, d: stats.partition_counts(_placed(s, d)),
        "partition_ids": lambda s, d: ring.partition_ids(s),
        "ring_owners": lambda s, d: ring.ring(s, NODES).select("partition_id", "owner"),
        "ring_backups": lambda s, d: ring.ring(s, NODES, backup_count=2).select("partition_id", F.array_join("backups", ",").alias("backups")),
        "ring_distribution": lambda s, d: ring.distribution(s, NODES),
        "ring_stats": lambda s, d: ring.ring_stats(s, NODES),
        "node_partitions": lambda s, d: ring.node_partitions(s, NODES, "n-1", role="backup"),
        "ring_nodes": lambda s, d: ring.all_nodes(s, NODES),
        "held_roles": _held_roles,
        "migrations_add": lambda s, d: ring.migrations_on_add(s, NODES, ADD),
        "migrations_remove": lambda s, d: ring.migrations_on_remove(s, NODES, REMOVE),
        "cluster_size": lambda s, d: stats.cluster_size(_embeddings(s, d)),
        "local_size": lambda s, d: stats.local_size(_placed(s, d), NODES, "n-0"),
        "local_backup_size": lambda s, d: stats.local_backup_size(_placed(s, d), NODES, "n-0"),
        "node_stats": lambda s, d: stats.sizes_by_node(_placed(s, d), NODES),
        "get_by_id": _get,
        "delete_anti": _deleted,
        "delete_exists": _exists,
        "log_latest": lambda s, d: changes.latest(_log(s, d)).select("vector_id", "version", "op"),
        "log_upsert_lww": lambda s, d: _state(changes.live(_log(s, d))),
        "log_replay_after_version": lambda s, d: changes.replay_after(_log(s, d), 9_000).select("version", "op", "vector_id"),
        "log_compaction_due": lambda s, d: changes.due_for_compaction(_log(s, d), _snapshots(s, d, (0.4,)), 30),
        "snapshot_latest": lambda s, d: _state(changes.latest_snapshot(_snapshots(s, d, (0.4, 0.7))).drop("snapshot_version")),
        "snapshot_plus_tail": _snapshot_tail,
        "export_partition": _exported,
        "log_files": _log_files,
        "snapshot_files": _snapshot_files,
        "collection_search": _collection_search,
        "collection_sizes": lambda s, d: _collection(s, d).stats(),
        "stream_ingest": _stream,
        "heartbeat_dead": lambda s, d: stats.dead_members(_events(s, d), 6 * 3600, node="user_id").select("user_id"),
        "recall_at_k": _recall,
        "latency_percentiles": _latency,
        "ann_lsh": _lsh,
        "ann_hnsw": _hnsw,
        "ann_lsh_filtered": _lsh_filtered,
        "ann_hnsw_filtered": _hnsw_filtered,
        "ann_recall": _ann_recall,
        "ann_recall_reached": _ann_reached,
        "collection_writes": _collection_writes,
        "collection_get": _collection_get,
        "collection_remove_partition": _collection_remove,
        "collection_rebuild": _collection_rebuild,
        "storage_stats": _storage,
        "ann_layer_stats": lambda s, d: ann.layer_stats(_graphs(s, d)),
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {f"knn_{m}": _knn_sql(m) for m in ("cosine", "euclidean", "dot")}
    out |= {f"knn_filter_{name}": _knn_sql(rows=_META, where=cond) for name, (_, cond) in FILTERS.items()}
    scatter = f"(SELECT e.*, {_PID.format('vec_id')} AS partition_id FROM embeddings e)"
    far = _DIST["cosine"].format(_V, _Q)
    live = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY version DESC) AS k FROM {0} WHERE {1}) WHERE k = 1 AND NOT gone)"
    cut4, cut7 = f"floor({_TOP} * 0.4)", f"floor({_TOP} * 0.7)"
    out |= {
        "knn_filter_variant": _knn_sql(rows=_META, where=FILTERS["and"][1]),
        "knn_batch": _batch_sql(),
        "knn_batch_euclidean": _batch_sql("euclidean"),
        "knn_batch_dot": _batch_sql("dot"),
        "knn_batch_grouped": _batch_sql(),
        "knn_per_partition": f"SELECT partition_id, vec_id, round(distance, 6) AS distance, 1::INTEGER AS rank FROM (SELECT partition_id, vec_id, {far} AS distance, row_number() OVER (PARTITION BY partition_id ORDER BY {far}, vec_id) AS k FROM {scatter} e) WHERE k = 1",
        "knn_scatter_gather": f"SELECT vec_id, round(distance, 6) AS distance, partition_id, {_owner_sql('partition_id', NODES)} AS source_node FROM (SELECT vec_id, partition_id, {far} AS distance FROM {scatter} e ORDER BY 3, 1 LIMIT {K})",
        "filter_missing_field": f"SELECT vec_id FROM {_META} WHERE quality <> 5",
        "filter_in_substring": f"SELECT vec_id FROM {_META} WHERE contains('src1 and src12', source)",
        "filter_ne_null": f"SELECT vec_id FROM {_META} WHERE quality IS NOT NULL",
        "filter_type_mismatch": f"SELECT vec_id FROM {_META} WHERE lang IS NOT NULL",
        "partition_assign": f"SELECT vec_id, {_PID.format('vec_id')} AS partition_id FROM embeddings",
        "partition_counts": f"SELECT {_PID.format('vec_id')} AS partition_id, count(*) AS vectors FROM embeddings GROUP BY 1",
        "partition_ids": "SELECT p::INTEGER AS partition_id FROM range(271) t(p)",
        "ring_owners": f"SELECT partition_id, owner FROM {_RING}",
        "ring_backups": f"SELECT p::INTEGER AS partition_id, {_owner_sql('(p + 1)', NODES)} || ',' || {_owner_sql('(p + 2)', NODES)} AS backups FROM range(271) t(p)",
        "ring_distribution": f"SELECT owner AS node, count(*) AS partitions FROM {_RING} GROUP BY 1",
        "ring_stats": f"SELECT count(*) AS nodes, 271::BIGINT AS partitions, min(n) AS min_per_node, max(n) AS max_per_node, 271.0::DOUBLE / count(*) AS ideal_per_node FROM (SELECT owner, count(*) AS n FROM {_RING} GROUP BY 1)",
        "node_partitions": f"SELECT partition_id FROM {_RING} WHERE backup = 'n-1'",
        "ring_nodes": f"SELECT DISTINCT owner AS node FROM {_RING}",
        "held_roles": f"SELECT n.node, r.partition_id, CASE WHEN n.node <> 'n-2' THEN vectors ELSE 0 END AS vectors, CASE n.node WHEN owner THEN 'primary' WHEN backup THEN 'backup' ELSE 'stale' END AS role FROM {_SIZES} r, (VALUES ('n-0'), ('n-1'), ('n-2')) n(node) WHERE n.node IN (owner, backup) OR n.node <> 'n-2' AND vectors > 0",
        "migrations_add": f"SELECT * FROM (SELECT p::INTEGER AS partition_id, {_owner_sql('p', NODES)} AS old_owner, {_owner_sql('p', (*NODES, ADD))} AS new_owner FROM range(271) t(p)) WHERE old_owner <> new_owner",
        "migrations_remove": f"SELECT * FROM (SELECT p::INTEGER AS partition_id, {_owner_sql('p', NODES)} AS old_owner, {_owner_sql('p', tuple(n for n in NODES if n != REMOVE))} AS new_owner FROM range(271) t(p)) WHERE old_owner = '{REMOVE}'",
        "cluster_size": "SELECT count(*) AS vectors FROM embeddings",
        "local_size": f"SELECT sum(vectors)::BIGINT AS vectors FROM {_SIZES} WHERE owner = 'n-0'",
        "local_backup_size": f"SELECT sum(vectors)::BIGINT AS vectors FROM {_SIZES} WHERE backup = 'n-0'",
        "node_stats": f"SELECT node, count(*) FILTER (role = 'p') AS primary_partitions, count(*) FILTER (role = 'b') AS backup_partitions, coalesce(sum(vectors) FILTER (role = 'p'), 0)::BIGINT AS primary_vectors, coalesce(sum(vectors) FILTER (role = 'b'), 0)::BIGINT AS backup_vectors FROM (SELECT owner AS node, 'p' AS role, vectors FROM {_SIZES} UNION ALL SELECT backup, 'b', vectors FROM {_SIZES}) GROUP BY 1",
        "get_by_id": "SELECT vec_id, label, len(embedding)::BIGINT AS dim FROM embeddings WHERE vec_id = 7",
        "delete_anti": "SELECT vec_id, label FROM embeddings WHERE label <> 3",
        "delete_exists": "SELECT i AS vec_id, EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = i) AS existed FROM (SELECT vec_id AS i FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT vec_id + 1 + (SELECT max(vec_id) FROM embeddings) FROM embeddings WHERE vec_id % 20 = 0)",
        "log_latest": f"SELECT vector_id, max(version) AS version, CASE WHEN arg_max(gone, version) THEN 'delete' ELSE 'insert' END AS op FROM {_LOG} GROUP BY 1",
        "log_upsert_lww": _state_sql(),
        "log_replay_after_version": f"SELECT version, CASE WHEN gone THEN 'delete' ELSE 'insert' END AS op, vector_id FROM {_LOG} WHERE version > 9000",
        "log_compaction_due": f"SELECT l.partition_id, count(*) AS entries FROM {_LOG} l LEFT JOIN (SELECT DISTINCT partition_id, {cut4} AS c FROM {live.format(_LOG, f'version <= {cut4}')}) s USING (partition_id) WHERE version > coalesce(c, -1) GROUP BY 1 HAVING count(*) >= 30",
        "snapshot_latest": f"WITH snaps AS (SELECT *, {cut4} AS cut FROM {live.format(_LOG, f'version <= {cut4}')} UNION ALL SELECT *, {cut7} FROM {live.format(_LOG, f'version <= {cut7}')}) SELECT vector_id, version, partition_id, round(value::DOUBLE, 3) AS value FROM snaps s WHERE cut = (SELECT max(cut) FROM snaps t WHERE t.partition_id = s.partition_id)",
        "snapshot_plus_tail": _state_sql(),
        "export_partition": f"WITH p AS (SELECT min(partition_id) AS pid FROM {_LOG}) SELECT vector_id, version, partition_id, (SELECT max(version) FROM {_LOG} l, p WHERE l.partition_id = pid) AS partition_version FROM ({_state_sql()}), p WHERE partition_id = pid",
        "log_files": _state_sql(),
        "snapshot_files": f"WITH snaps AS (SELECT *, {cut4} AS cut FROM {live.format(_LOG, f'version <= {cut4}')} UNION ALL SELECT *, {cut7} FROM {live.format(_LOG, f'version <= {cut7}')}) SELECT vector_id, partition_id, cut::BIGINT AS snapshot_version, round(value::DOUBLE, 3) AS value FROM snaps s WHERE cut = (SELECT max(cut) FROM snaps t WHERE t.partition_id = s.partition_id)",
        "collection_search": f"SELECT vec_id, round(distance, 6) AS distance, partition_id, {_owner_sql('partition_id', NODES)} AS source_node FROM (SELECT vec_id, {_PID.format('vec_id')} AS partition_id, {far} AS distance FROM {_META} e WHERE lang <> 'en' AND NOT vec_id BETWEEN 20 AND 39 ORDER BY 3, 1 LIMIT {K})",
        "stream_ingest": f"SELECT vector_id, partition_id, value FROM ({_state_sql()})",
        "heartbeat_dead": "SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR",
        "recall_at_k": _recall_sql(),
        "ann_recall_reached": "SELECT * FROM (VALUES ('lsh', true), ('hnsw', true), ('lsh filtered', true), ('hnsw filtered', true)) t(strategy, reached)",
        "collection_writes": "SELECT vec_id, round(CASE WHEN vec_id % 20 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS x FROM embeddings WHERE vec_id % 30 <> 0",
        "collection_get": "SELECT t.i AS vector_id, e.vec_id IS NOT NULL AS found, coalesce(len(e.embedding), 0)::INTEGER AS dim FROM (VALUES ('5'), ('7'), ('none')) t(i) LEFT JOIN embeddings e ON e.vec_id::VARCHAR = t.i AND e.vec_id <> 7",
        "collection_remove_partition": f"SELECT pid AS partition_id, count(*) AS vectors FROM (SELECT {_PID.format('vec_id')} AS pid FROM embeddings) WHERE pid <> (SELECT {_PID.format('vec_id')} FROM embeddings WHERE vec_id = 0) GROUP BY 1",
        "collection_rebuild": "SELECT step, vec_id AS query_id, vec_id % 40 = 0 AS itself FROM embeddings, (VALUES ('written'), ('rebuilt')) t(step) WHERE vec_id % 20 = 0",
        "storage_stats": f"SELECT count(DISTINCT partition_id) AS log_files, (SELECT count(DISTINCT partition_id) FROM {live.format(_LOG, f'version <= {cut4}')}) + (SELECT count(DISTINCT partition_id) FROM {live.format(_LOG, f'version <= {cut7}')}) AS snapshot_files FROM {_LOG}",
        "latency_percentiles": "SELECT round(avg(value), 3) AS mean_ms, round(quantile_cont(value, 0.5), 3) AS p50_ms, round(quantile_cont(value, 0.95), 3) AS p95_ms, round(count(value) / (sum(value) / 1000.0), 3) AS qps FROM events WHERE value > 0",
    }
    out["collection_sizes"] = out["node_stats"]
    return out
