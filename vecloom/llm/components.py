"""Connected components of a graph of any size, by alternating large-star and
small-star steps (Kiveris et al., 2014).  Each step is an aggregation and a
join; nothing but a fingerprint of the edges reaches the driver.

A node with very many neighbours is the centre of a star: its edges are dealt
to many places, and its least neighbour goes to each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import scope, stored

#: Edges a worker holds while it contracts its own share.
HELD = 1 << 20
#: Edges of a node that meet in one place, at least, and nodes that may be known as centres, at most (a bound of the broadcast).
STAR, CENTRES = 1024, 100_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each share of the edges becomes stars around its components' least nodes."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[:len(a)], at[len(a):]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if (root == before).all() and (root[x] == root[y]).all():
                break
        own = root != np.arange(len(nodes))
        return pa.record_batch({"u": nodes[own], "v": nodes[root[own]]}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += len(batch)
        if held >= HELD:
            yield stars(np.concatenate(a), np.concatenate(b))
            a, b, held = [], [], 0
    if held:
        yield stars(np.concatenate(a), np.concatenate(b))


def _with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """(u, v, m): each edge with its node's ``m``; ``least`` has u, m and the node's number of edges c.

    Nodes of more than ``star`` edges are at most CENTRES, so their list may be
    broadcast whatever the size of the graph.
    """
    star = max(STAR, -(-2 * count // CENTRES))
    cells = F.ceil(F.col("c") / F.lit(float(star))).cast("int")
    hot = F.broadcast(least.where(F.col("c") > star).select(F.col("u").alias("h_u"), cells.alias("h_cells")))
    spot = F.when(F.col("h_cells").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.col("h_cells").cast("long")).cast("int"))
    dealt = edges.join(hot, F.col("u") == F.col("h_u"), "left").select("u", "v", spot.alias("cell"))
    to_all = least.select(F.col("u").alias("l_u"), "m", F.explode(F.sequence(F.lit(0), cells - 1)).alias("l_cell"))
    return dealt.join(to_all, (F.col("u") == F.col("l_u")) & (F.col("cell") == F.col("l_cell"))).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that is not the least of its component.

    ``edges`` has long columns u, v; loops, repeats and either direction are
    allowed, nulls are ignored.  What is left as HELD edges or fewer after the
    workers' own contractions is contracted by one of them.
    """
    with scope(edges.sparkSession) as own:
        e = edges.where("u is not null and v is not null and u <> v").select("u", "v")
        e = stored(e.mapInArrow(_local_stars, "u long, v long").distinct(), "edges")
        seen = None
        while True:
            mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
            if seen is None and 0 < mark[0] <= HELD:
                # so few edges are one share, whose stars are the components
                e = stored(e.coalesce(1).mapInArrow(_local_stars, "u long, v long"), "edges")
            if mark[0] <= HELD and seen is None or mark == seen:
                own.keep(e)
                out = e.select("u", F.col("v").alias("root"))
                out._scratch = e._scratch
                return out
            seen = mark
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("c"))
            large = _with_least(both.where("v > u"), least, mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            large = stored(large.distinct(), "edges")
            low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
            small = _with_least(large, low, mark[0]).select(
                F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            e = stored(small.select(F.col("e.u").alias("u"), F.col("e.v").alias("v")).where("u <> v").distinct(), "edges")
