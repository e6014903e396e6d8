"""Approximate neighbours: random-hyperplane hashing with several probes, and graphs per shard.

Both take filters and answer a query set against all rows and end with exact distances of their
candidates; ``knn.recall_at_k`` measures them against the exact search, which
stays the default.
"""

from __future__ import annotations

import functools
import heapq
import io
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.distance import check_metric
from .knn import _top, check_k, exact_distances, query_groups, search_matrix

STRATEGIES = ("auto", "exact", "lsh", "hnsw")
#: Rows up to which "auto" stays exact, and rows of a graph's shard.
EXACT_ROWS, SHARD_ROWS = 1_000_000, 20_000
#: Rows that the search of a graph keeps on its way, if not told otherwise.
EF = 50


def check_strategy(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(STRATEGIES)}")
    return name


class Hyperplanes:
    """Codes of vectors by the sides of random hyperplanes, and the codes that a query looks up: its own and the likeliest others."""

    def __init__(self, dim: int, tables: int, bits: int, probes: int, seed: int):
        self.tables, self.bits, self.probes = tables, bits, probes
        self.planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
        flips = [1 << i for i in range(bits)] + [1 << i | 1 << j for i in range(bits) for j in range(i)]
        self.flips = np.array(flips, np.int64)
        self.sets = (self.flips[:, None] >> np.arange(bits) & 1).astype(np.float64)

    def sides(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.planes).reshape(len(x), self.tables, self.bits)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return ((self.sides(x) > 0) * (1 << np.arange(self.bits, dtype=np.int64))).sum(2)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """(queries, tables, 1 + probes) codes: one or two sides flipped, those nearest to the query first."""
        side = self.sides(q)
        own = ((side > 0) * (1 << np.arange(self.bits, dtype=np.int64))).sum(2)
        cost = (side ** 2) @ self.sets.T
        first = np.argsort(cost, axis=2, kind="stable")[:, :, :self.probes]
        return np.concatenate([own[:, :, None], own[:, :, None] ^ self.flips[first]], axis=2)


@functools.cache
def _planes(dim: int, tables: int, bits: int, probes: int, seed: int) -> Hyperplanes:
    return Hyperplanes(dim, tables, bits, probes, seed)


def search_lsh(vectors: DataFrame, queries: DataFrame, k: int, dim: int, *, metric: str = "cosine", id_col: str = "vector_id", col: str = "embedding",
               query_id: str = "query_id", tables: int = 32, bits: int = 9, probes: int = 16, seed: int = 7, where: Any = None, metadata: str | None = None) -> DataFrame:
    """query_id, id, distance, rank among rows that have one of the query's codes in any table.

    Candidates of all tables are joined in a task, block by block as in
    ``knn.search_matrix``, so a pair is looked at once and only k rows a query
    leave the task.  ``where`` is applied before.
    """
    check_k(k)
    check_metric(metric)

    def candidates(v: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
        planes = _planes(dim, tables, bits, probes, seed)
        mine, asked = planes.codes(v), planes.probed(q)
        met = np.zeros((len(q), len(v)), bool)
        owner = np.repeat(np.arange(len(q)), asked.shape[2])
        for t in range(tables):
            code = asked[:, t].ravel()
            order = np.argsort(code, kind="stable")
            lo, hi = np.searchsorted(code[order], mine[:, t], "left"), np.searchsorted(code[order], mine[:, t], "right")
            n = hi - lo
            row = np.repeat(np.arange(len(v)), n)
            spot = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            met[owner[order][spot], row] = True
        return np.nonzero(met)

    return search_matrix(vectors, queries, k, metric=metric, id_col=id_col, col=col, query_id=query_id, where=where, metadata=metadata, candidates=candidates)


class Graph:
    """A hierarchical navigable small world (Malkov and Yashunin, 2016) over the rows of a matrix."""

    def __init__(self, x: np.ndarray, metric: str, m: int = 16, ef_build: int = 100, seed: int = 0):
        self.metric, self.m = metric, m
        self.x = x.astype(np.float64)
        self.unit = self._prepared(self.x)
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1
        levels = np.minimum((-np.log(np.random.default_rng(seed).random(len(x))) / np.log(m)).astype(int), 32)
        for i, level in enumerate(levels.tolist()):
            self._insert(i, level, ef_build)
        self._reach_all()

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return x
        norm = np.linalg.norm(x, axis=-1, keepdims=True)
        return x / np.where(norm == 0, 1, norm)

    def _far(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        y = self.unit[rows]
        if self.metric == "euclidean":
            return ((y - q) ** 2).sum(1)
        return -(y @ q)

    def _walk(self, q: np.ndarray, start: list[int], ef: int, layer: int, allowed: np.ndarray | None = None, crossed: list[int] | None = None) -> list[tuple[float, int]]:
        """Best-first search of a layer; only allowed rows are kept, all are crossed.  Rows whose edges it follows are added to ``crossed``."""
        edges = self.layers[layer]
        seen = set(start)
        todo = list(zip(self._far(q, start).tolist(), start))
        heapq.heapify(todo)
        kept = [(-d, i) for d, i in todo if allowed is None or allowed[i]]
        heapq.heapify(kept)
        while todo:
            d, i = heapq.heappop(todo)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            if crossed is not None:
                crossed.append(i)
            new = [j for j in edges.get(i, ()) if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self._far(q, new).tolist(), new):
                if len(kept) < ef or e < -kept[0][0]:
                    heapq.heappush(todo, (e, j))
                    if allowed is None or allowed[j]:
                        heapq.heappush(kept, (-e, j))
                        if len(kept) > ef:
                            heapq.heappop(kept)
        return sorted((-d, i) for d, i in kept)

    def _diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are closer to the point than to each other, filled up with the nearest."""
        out: list[int] = []
        for d, i in near:
            if len(out) == most:
                return out
            if not out or (self._far(self.unit[i], out) > d).all():
                out.append(i)
        rest = [i for _, i in near if i not in out]
        return out + rest[:most - len(out)]

    def _insert(self, i: int, level: int, ef: int) -> None:
        top = len(self.layers) - 1
        while len(self.layers) <= level:
            self.layers.append({})
        for layer in range(level + 1):
            self.layers[layer].setdefault(i, [])
        if self.entry >= 0:
            at = [self.entry]
            for layer in range(top, level, -1):
                at = [self._walk(self.unit[i], at, 1, layer)[0][1]]
            for layer in range(min(top, level), -1, -1):
                near = self._walk(self.unit[i], at, ef, layer)
                most = self.m * (2 if layer == 0 else 1)
                for j in self._diverse(near, self.m):
                    self.layers[layer][i].append(j)
                    back = self.layers[layer][j]
                    back.append(i)
                    if len(back) > most:
                        order = sorted(zip(self._far(self.unit[j], back).tolist(), back))
                        self.layers[layer][j] = self._diverse(order, most)
                at = [j for _, j in near]
        if self.entry < 0 or level > top:
            self.entry = i

    def _reach_all(self) -> None:
        """Edges to the rows that a search for their own vector misses, from the nearest row that it finds.

        Pruning can cut a row, or a group of near copies, off from all others.
        A search with more than EF rows, or a filter, crosses all that one with
        EF crosses, so it finds them too.  A new edge can turn other walks
        aside: those that crossed its row are taken again, until none misses.
        Of more than EF copies (to nine digits) some may stay out.
        """
        ways: dict[int, np.ndarray] = {}
        asked: list[int] = list(range(len(self.x)))
        while asked:
            changed = np.zeros(len(self.x), bool)
            for i in asked:
                unit, way = self._prepared(self.x[i]), []
                near = self._near(unit, EF, crossed=way)
                ways[i] = np.array(way, np.int32)
                own = self._far(unit, [i])[0]
                if all(j != i for _, j in near) and (len(near) < EF or near[-1][0] - own > 1e-9 * abs(own)):
                    self.layers[0][near[0][1]].append(i)
                    changed[near[0][1]] = True
            asked = [i for i, way in ways.items() if changed[way].any()]

    def _near(self, unit: np.ndarray, ef: int, allowed: np.ndarray | None = None, crossed: list[int] | None = None) -> list[tuple[float, int]]:
        """The walk through all layers."""
        at = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = [self._walk(unit, at, 1, layer)[0][1]]
        return self._walk(unit, at, ef, 0, allowed, crossed)

    def search(self, q: np.ndarray, k: int, ef: int | None = None, allowed: np.ndarray | None = None) -> list[int]:
        """Rows near a query; ``ef`` unset or 0 is EF, four times k at least under a filter.  With EF or more a row's own vector finds it."""
        check_k(k)
        if self.entry < 0:
            return []
        if len(q) != self.x.shape[1]:
            raise ValueError(f"query of length {len(q)}, not {self.x.shape[1]}")
        ef = max(ef or EF, k if allowed is None else 4 * k)
        return [i for _, i in self._near(self._prepared(np.asarray(q, np.float64)), ef, allowed)][:max(k, ef)]

    def stats(self) -> list[tuple[int, int, float]]:
        """(layer, nodes, average neighbours)."""
        return [(n, len(e), sum(map(len, e.values())) / max(len(e), 1)) for n, e in enumerate(self.layers)]

    def dump(self) -> bytes:
        flat = [(n, i, j) for n, e in enumerate(self.layers) for i, js in e.items() for j in (js or [-1])]
        out = io.BytesIO()
        np.savez(out, x=self.x.astype(np.float32), edges=np.array(flat, np.int32).reshape(-1, 3), head=np.array([self.entry, self.m]), metric=np.array(self.metric))
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Graph:
        got = np.load(io.BytesIO(blob))
        self = cls(np.zeros((0, got["x"].shape[1])), str(got["metric"]), int(got["head"][1]))
        self.x = got["x"].astype(np.float64)
        self.unit, self.entry = self._prepared(self.x), int(got["head"][0])
        for n, i, j in got["edges"].tolist():
            while len(self.layers) <= n:
                self.layers.append({})
            edges = self.layers[n].setdefault(i, [])
            if j >= 0:
                edges.append(j)
        return self


def build_graphs(vectors: DataFrame, *, metric: str = "cosine", id_col: str = "vector_id", col: str = "embedding", shard_rows: int = SHARD_ROWS, m: int = 16, ef_build: int = 100, seed: int = 7, by: str | None = None) -> DataFrame:
    """part, shard, shards, ids, graph (bytes), layers: one row a shard of about ``shard_rows`` rows, dealt by a hash of the id.

    With ``by`` each value of that column (``part``, a whole number) has
    shards of its own; else part is 0.  Rows of a shard are sorted by id and
    levels are drawn from ``seed``, so a rebuilt shard is the same graph.
    """
    check_metric(metric)
    body = vectors.where(F.col(col).isNotNull()).select(id_col, col, (F.col(by) if by else F.lit(0)).cast("int").alias("part"))
    # a row a part
    sizes = body.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(shard_rows))), F.lit(1)).cast("int").alias("shards"))
    ids_type = T.ArrayType(vectors.schema[id_col].dataType)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("shards", T.IntegerType()), T.StructField("ids", ids_type), T.StructField("graph", T.BinaryType()),
                           T.StructField("layers", T.ArrayType(T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("nodes", T.LongType()), T.StructField("avg_neighbors", T.DoubleType())])))])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable")
        graph = Graph(np.stack(pdf[col].to_numpy()), metric, m, ef_build, seed)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "shard": [pdf["_shard"].iloc[0]], "shards": [pdf["shards"].iloc[0]], "ids": [pdf[id_col].tolist()], "graph": [graph.dump()],
                             "layers": [[{"layer": a, "nodes": b, "avg_neighbors": c} for a, b, c in graph.stats()]]})

    dealt = body.join(F.broadcast(sizes), "part").withColumn("_shard", _shard_of(id_col))
    # a shard takes minutes, few bytes: with the number given, small ones aren't put into one task
    dealt = dealt.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "_shard")
    return dealt.groupBy("part", "_shard").applyInPandas(build, schema)


def _shard_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col("shards").cast("long")).cast("int")


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", id_col: str = "vector_id", query_id: str = "query_id", ef: int | None = None,
                  allowed: DataFrame | None = None, limited: Sequence[int] | None = None) -> DataFrame:
    """query_id, id, distance, rank: each shard's graph is probed with every query, group by group, and the shards' results are merged.

    ``allowed`` (id, part) names the rows that may be found: a shard's walk
    crosses all its nodes and keeps these.  With ``limited`` only shards of
    those parts are so restricted.  A graph keeps k rows a query.
    """
    check_k(k)
    id_type = graphs.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField(id_col, id_type), T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    probed = graphs.select("part", "shard", "ids", "graph", F.lit(None).cast(T.ArrayType(id_type)).alias("ok"))
    if allowed is not None:
        parts = graphs.select(F.col("part").alias("g_part"), "shards").distinct()
        placed = allowed.join(F.broadcast(parts), F.col("part") == F.col("g_part")).select("part", _shard_of(id_col).alias("shard"), id_col)
        # ids of a shard, which is bounded
        ok = placed.groupBy("part", "shard").agg(F.collect_list(id_col).alias("ok"))
        probed = probed.drop("ok").join(ok, ["part", "shard"], "left")
        none, free = F.array().cast(T.ArrayType(id_type)), F.lit(False) if limited is None else ~F.col("part").isin(list(limited))
        probed = probed.withColumn("ok", F.when(~free, F.coalesce("ok", none))).where("ok is null or size(ok) > 0")
    packed, groups, width = query_groups(queries, query_id, "embedding")

    def pass_over(g: int) -> DataFrame:
        held = (packed if groups == 1 else packed.where(F.col("g") == g)).collect()
        shared = queries.sparkSession.sparkContext.broadcast([(r["ids"], bytes(r["matrix"])) for r in held])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, blob, ok in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    graph = Graph.load(blob)
                    mask = None if ok is None else np.isin(np.array(ids), np.array(ok))
                    for names, matrix in shared.value:
                        out: tuple = ([], [], [])
                        for name, one in zip(names, np.frombuffer(matrix).reshape(len(names), -1)):
                            found = graph.search(one, k, ef, mask)
                            if found:
                                near = exact_distances(graph.x[found], np.broadcast_to(one, (len(found), len(one))), metric)
                                best = sorted(zip(near.tolist(), (ids[i] for i in found)))[:k]
                                out[0].extend([name] * len(best))
                                out[1].extend(i for _, i in best)
                                out[2].extend(d for d, _ in best)
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, arrow.types)], schema=arrow)

        return probed.select("ids", "graph", "ok").mapInArrow(probe, schema)

    out = None
    for g in range(groups if width else 0):
        out = pass_over(g) if out is None else out.unionByName(pass_over(g))
    return _top(queries.sparkSession.createDataFrame([], schema) if out is None else out, ["query_id"], k, id_col)


def layer_stats(graphs: DataFrame) -> DataFrame:
    """layer, nodes, avg_neighbors over all shards."""
    each = graphs.select(F.explode("layers").alias("l")).select("l.*")
    return each.groupBy("layer").agg(F.sum("nodes").alias("nodes"), (F.sum(F.col("nodes") * F.col("avg_neighbors")) / F.sum("nodes")).alias("avg_neighbors"))
