"""Exact nearest neighbours.

A single query is a projection and ``ORDER BY distance, id LIMIT k``: Spark
keeps k rows a task (``TakeOrderedAndProject``) and merges them.  A batch runs
in blocks: queries and vectors meet as matrices of a bounded size, a product
picks the candidates of each query with a margin for its rounding, and these
get the very distance, summed in the same order, that a single query would
give them.  Each task keeps k rows a query before the shuffle.  Queries that
fit a bound in bytes are broadcast; more of them are dealt to groups of that
size and meet the blocks of vectors in a join.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.distance import as_vector, check_metric, distance, literal_norm, squared_norm
from ..functions.hashing import PARTITIONS, partition_of
from ..functions.predicates import apply_filter
from ..workspace import settings, stored
from .ring import owner_of

#: Bytes of queries that may be broadcast, and of a matrix held by a worker, about.
BROADCAST_BYTES, HELD_BYTES = 1 << 26, 1 << 26
#: Vectors of a block.
BLOCK = 4096


def check_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError(f"k must be a whole number of 1 or more, not {k!r}")
    return k


def checked(vectors: DataFrame, dim: int | None, col: str = "embedding") -> DataFrame:
    """Fail the job at a null vector or one of another length than ``dim``."""
    if dim is None:
        return vectors
    fits = F.coalesce(F.size(col), F.lit(-1)) == dim
    fault = F.raise_error(F.concat(F.lit(f"vector of another length than {dim}: "), F.coalesce(F.size(col), F.lit(-1)).cast("string")))
    return vectors.withColumn(col, F.when(fits, F.col(col)).otherwise(fault))


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, *, metric: str = "cosine", where: Any = None, metadata: str | None = None,
           id_col: str = "vector_id", col: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows: id, distance, ``keep`` columns.

    Rows without a vector are skipped.  Fewer than k rows come back when fewer
    match; an empty table gives an empty result.
    """
    check_k(k)
    check_metric(metric)
    rows = apply_filter(vectors, where, metadata).where(F.col(col).isNotNull())
    near = rows.select(id_col, distance(F.col(col), as_vector(query), metric, literal_norm(query)).alias("distance"), *keep)
    return near.orderBy("distance", id_col).limit(k)


def search_by_id(vectors: DataFrame, query_id: Any, k: int = 10, *, metric: str = "cosine", id_col: str = "vector_id", col: str = "embedding",
                 where: Any = None, metadata: str | None = None) -> DataFrame:
    """Neighbours of a stored vector, itself included; the query is one broadcast row.  An unknown id has none."""
    check_k(k)
    one = vectors.where(F.col(id_col) == F.lit(query_id)).select(F.col(col).alias("_q"), squared_norm(F.col(col)).alias("_qn")).limit(1)
    rows = apply_filter(vectors, where, metadata).where(F.col(col).isNotNull())
    near = rows.join(F.broadcast(one)).select(id_col, distance(F.col(col), F.col("_q"), metric, F.col("_qn")).alias("distance"))
    return near.orderBy("distance", id_col).limit(k)


def _top(rows: DataFrame, by: list[str], k: int, id_col: str) -> DataFrame:
    """The k nearest of each group, ranked from 1."""
    w = Window.partitionBy(*by).orderBy("distance", id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_distances(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows, every sum taken from the first dimension to the last as the Column expressions do."""

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    if metric == "euclidean":
        return np.sqrt(total((v - q) * (v - q)))
    if metric == "dot":
        return -total(v * q)
    norms = np.sqrt(total(v * v) * total(q * q))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms == 0, 1.0, 1.0 - total(v * q) / norms)


def _candidates(v: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs among which are each query's k nearest, ties included: a product and a margin for its rounding."""
    product, v2, q2 = q @ v.T, (v * v).sum(1), (q * q).sum(1)
    if metric == "euclidean":
        d, scale = v2[None, :] - 2 * product, q2[:, None] + v2.max(initial=0.0)
    elif metric == "dot":
        d, scale = -product, np.sqrt(q2[:, None] * v2.max(initial=0.0))
    else:
        norms = np.sqrt(np.outer(q2, v2))
        with np.errstate(invalid="ignore", divide="ignore"):
            d, scale = np.where(norms == 0, 0.0, -product / norms), 1.0
    m = min(k, d.shape[1])
    return np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1:m] + 1e-9 * scale)


def _best(parts: list[tuple], k: int) -> tuple:
    """The k nearest of each query among the gathered (query, distance, id)."""
    of, dist, who = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((who, dist, of))
    of, dist, who = of[order], dist[order], who[order]
    keep = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[keep], dist[keep], who[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _names(column: pa.Array) -> np.ndarray:
    own = column.to_numpy(zero_copy_only=False)
    return own.astype(str) if own.dtype == object else own


def block_nearest(v: np.ndarray, who: np.ndarray, q: np.ndarray, k: int, metric: str, candidates=None) -> tuple:
    """(query, distance, id) of the k nearest rows of a block for each query; ``candidates`` gives pairs instead of the exact choice."""
    of, at = (candidates or _candidates)(v, q, k, metric)
    step = max(1, HELD_BYTES // (24 * max(1, v.shape[1])))
    got = (np.zeros(0, np.int64), np.zeros(0), who[:0])
    for a in range(0, len(of), step):
        o, t = of[a:a + step], at[a:a + step]
        got = _best([got, (o, exact_distances(v[t], q[o], metric), who[t])], k)
    return got


def query_groups(queries: DataFrame, query_id: str, query_col: str) -> tuple[DataFrame, int, int]:
    """Queries packed into rows (g, ids, matrix) of blocks, the number of groups g, and their dimension.

    A group has BROADCAST_BYTES at most, about, a block so many queries that
    its distances to a block of vectors have HELD_BYTES.
    """
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_col).alias("_q"))
    n, least, width = asked.agg(F.count(F.lit(1)), F.min(F.size("_q")), F.max(F.size("_q"))).first()
    if n and least != width:
        raise ValueError(f"queries of lengths {least} and {width}")
    groups = max(1, -(-n * (width or 1) * 8 // BROADCAST_BYTES))
    size = max(1, HELD_BYTES // (8 * BLOCK))
    kind = asked.schema["query_id"].dataType
    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("matrix", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
            for a, b in zip(cut, [*cut[1:], len(g)]):
                for x in range(int(a), int(b), size):
                    part = batch.slice(x, min(size, int(b) - x))
                    yield pa.record_batch([pa.array([int(g[x])], pa.int32()), pa.array([part.column(1).to_pylist()], arrow.field("ids").type), pa.array([_matrix(part.column(2)).tobytes()], pa.binary())], schema=arrow)

    dealt = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("g"), "query_id", "_q")
    if groups > 1:
        dealt = dealt.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(pack, schema), groups, width or 0


def search_matrix(vectors: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "cosine", id_col: str = "vector_id", col: str = "embedding",
                  query_id: str = "query_id", query_col: str = "embedding", where: Any = None, metadata: str | None = None, candidates=None) -> DataFrame:
    """query_id, id, distance, rank: k nearest rows of every query, for any number of queries and rows.

    The order of near ties is that of ``search``, whatever the number of
    queries.  Rows and queries without a vector are skipped; queries of several
    lengths are a ``ValueError``.  ``candidates`` is for approximate searches:
    a function from blocks to the pairs to look at.
    """
    check_k(k)
    check_metric(metric)
    spark = vectors.sparkSession
    rows = apply_filter(vectors, where, metadata).where(F.col(col).isNotNull()).select(id_col, col)
    packed, groups, width = query_groups(queries, query_id, query_col)
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField(id_col, id_type), T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    if not width:
        return _top(spark.createDataFrame([], schema), ["query_id"], k, id_col)

    def told(names: list, best: tuple) -> pa.RecordBatch:
        of, dist, who = best
        return pa.record_batch([pa.array(c, t) for c, t in zip(([names[i] for i in of], who.tolist(), dist), arrow.types)], schema=arrow)

    def spread(block: pa.Array) -> Iterator[tuple[int, int]]:
        step = min(BLOCK, max(1, HELD_BYTES // (8 * width)))
        return ((a, min(step, len(block) - a)) for a in range(0, len(block), step))

    if groups == 1:
        shared = spark.sparkContext.broadcast([(r["ids"], bytes(r["matrix"])) for r in packed.collect()])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [(ids, np.frombuffer(m).reshape(len(ids), -1)) for ids, m in shared.value]
            held: list = [None] * len(blocks)
            for batch in batches:
                for a, n in spread(batch):
                    v, who = _matrix(batch.column(1).slice(a, n)), _names(batch.column(0).slice(a, n))
                    for i, (_, q) in enumerate(blocks):
                        new = block_nearest(v, who, q, k, metric, candidates)
                        held[i] = new if held[i] is None else _best([held[i], new], k)
            for (ids, _), best in zip(blocks, held):
                if best is not None:
                    yield told(ids, best)

        return _top(rows.mapInArrow(near, schema), ["query_id"], k, id_col)

    pack_schema = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("own", T.ArrayType(id_type)), T.StructField("v", T.BinaryType())])
    pack_arrow = to_arrow_schema(pack_schema)
    # as many places as the session has shuffle partitions: a group's blocks of queries go to several of them
    cells = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for a, n in spread(batch):
                turn += 1
                yield pa.record_batch([pa.array([turn % cells], pa.int32()), pa.array([batch.column(0).slice(a, n).to_pylist()], pack_arrow.field("own").type), pa.array([_matrix(batch.column(1).slice(a, n)).tobytes()], pa.binary())], schema=pack_arrow)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for own, v, ids, m in zip(*(batch.column(c) for c in ("own", "v", "ids", "matrix"))):
                block = np.frombuffer(v.as_buffer()).reshape(-1, width)
                q = np.frombuffer(m.as_buffer()).reshape(-1, width)
                key = repr(ids.as_py()), m.as_buffer().to_pybytes()
                new = block_nearest(block, _names(own.values), q, k, metric, candidates)
                if key in held:
                    held[key] = held[key][0], _best([held[key][1], new], k)
                else:
                    held[key] = ids.as_py(), new
                if sum(len(b[1][0]) for b in held.values()) > HELD_BYTES // 64:
                    yield from (told(*b) for b in held.values())
                    held.clear()
        yield from (told(*b) for b in held.values())

    left = rows.mapInArrow(pack, pack_schema).withColumn("vg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = packed.withColumn("qc", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    both = left.join(right.hint("merge"), (F.col("vg") == F.col("g")) & (F.col("c") == F.col("qc"))).select("own", "v", "ids", "matrix")
    # rows are megabytes each
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        found = stored(both.mapInArrow(meet, schema), "nearest")
    return _top(found, ["query_id"], k, id_col)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, **how: Any) -> DataFrame:
    """``search_matrix`` under the name of what it does."""
    return search_matrix(vectors, queries, k, **how)


def search_partitions(vectors: DataFrame, query: Column, k: int = 10, *, metric: str = "cosine", num_partitions: int = PARTITIONS,
                      id_col: str = "vector_id", col: str = "embedding") -> DataFrame:
    """k nearest rows within each partition of ids: partition_id, id, distance, rank."""
    check_k(k)
    rows = vectors.where(F.col(col).isNotNull()).select(
        partition_of(F.col(id_col), num_partitions).alias("partition_id"), id_col, distance(F.col(col), query, metric).alias("distance"))
    return _top(rows, ["partition_id"], k, id_col)


def scatter_gather(vectors: DataFrame, query: Column, nodes: Sequence[str], k: int = 10, *, metric: str = "cosine", num_partitions: int = PARTITIONS,
                   id_col: str = "vector_id", col: str = "embedding") -> DataFrame:
    """Partition-local top k, top k of each owner, then the k nearest: id, distance, partition_id, source_node."""
    local = search_partitions(vectors, query, k, metric=metric, num_partitions=num_partitions, id_col=id_col, col=col).drop("rank")
    placed = local.withColumn("source_node", owner_of(F.col("partition_id"), nodes))
    per_node = _top(placed, ["source_node"], k, id_col).drop("rank")
    return per_node.orderBy("distance", id_col).limit(k)


def recall_at_k(exact: DataFrame, found: DataFrame, k: int, *, id_col: str = "vector_id") -> DataFrame:
    """query_id, recall: the share of each query's k exact neighbours that ``found`` has."""
    hits = exact.join(found.select("query_id", id_col), ["query_id", id_col], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    every = exact.select("query_id").distinct()
    return every.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(check_k(k)))).alias("recall"))


def latency_stats(times: DataFrame, col: str = "ms") -> DataFrame:
    """mean, median, p95 (exact, linear between ranks) and queries a second of latencies in milliseconds."""
    return times.agg(
        F.avg(col).alias("mean_ms"), F.percentile(col, F.lit(0.5)).alias("p50_ms"), F.percentile(col, F.lit(0.95)).alias("p95_ms"),
        F.try_divide(F.count(col).cast("double"), F.sum(col) / 1000.0).alias("qps"))
