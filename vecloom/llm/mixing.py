"""Operator 2: mixing sources to target weights by the cube method.

Targets come from the sources' weights by filling up: a source stops at a
multiple of its size and the excess is shared again by weight.  A document is
taken target / size times on average; the whole part is certain, the fraction
is an inclusion probability.  The flight phase of the cube method moves these
probabilities along directions that change neither the number of documents nor
the number of words taken, until they are 0 or 1.

Flights run in blocks of bounded size (a hot source has many blocks, and
repeated rows are numbered, so that they too are dealt to many); each leaves two documents at most undecided, and those meet in blocks of the next
level until one block per source is left.  There a dozen documents of halving sizes are
kept from the flight and landed with the last two by the rounding, of all, that
misses the words least.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import stored

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK = 8192
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def targets(sources: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rank, docs, source_size, target from (source, docs, source_size).

    Sources are ranked by code point, null last; ``weights`` repeat along the
    ranks.  The table has a row per source only.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = ranked.select("*", weight.alias("w"), (F.lit(most) * F.col("source_size")).alias("cap")).select(
        "*", (F.lit(share) * F.sum("source_size").over(everything)).alias("total"), F.sum("w").over(everything).alias("all_w"))
    # the sources that stop are those of the least cap per weight
    so_far = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = filled.select("*", F.sum("cap").over(so_far).alias("caps"), F.sum("w").over(so_far).alias("ws"))
    level = (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - (F.col("ws") - F.col("w")))
    steps = steps.withColumn("level", level).withColumn("stops", F.col("level") * F.col("w") > F.col("cap"))
    free = F.min(F.when(~F.col("stops"), F.struct(F.col("caps"), F.col("level")))).over(everything)["level"]
    return steps.select("source", "rank", "docs", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(free * F.col("w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping their sum and the sum of p * size; two at most stay undecided."""
    p = p.tolist()
    s = size.tolist()
    held: list[int] = []
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, d in zip(held, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        held = []
        for k, d in zip((a, b, c), u):
            p[k] += step * d
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = float(round(p[k]))
            else:
                held.append(k)
    return np.array(p)


#: Documents of the last block that fly no further but are landed together.
LANDED = 12


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the undecided, all ways tried, so that the words taken change least, then the documents."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1) - p[open_]
    words, documents = np.abs(ways @ size[open_]), np.abs(ways.sum(1))
    best = np.lexsort((documents, words))[0]
    p = p.copy()
    p[open_] = np.round(p[open_] + ways[best])
    return p


def _fly(seed: int, last: bool):
    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size", "nth"], kind="stable", na_position="last").reset_index(drop=True)
        rng = random.Random(f"{seed}:{int(key[0])}:{int(key[1])}")
        p, size = pdf["p"].to_numpy().copy(), pdf["size"].to_numpy().astype(float)
        flies = np.ones(len(p), bool)
        if last or int(key[1]) == 0:
            # a source's first block and its last keep documents of halving sizes for the landing: their sums can mend
            # whatever the flight leaves
            open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist()
            goal = max((size[i] for i in open_), default=0.0)
            for _ in range(min(LANDED, len(open_))):
                k = min(range(len(open_)), key=lambda j: (abs(size[open_[j]] - goal), j))
                flies[open_.pop(k)] = False
                goal /= 2
        p[flies] = flight(p[flies], size[flies], rng)
        p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
        pdf["p"] = landing(p, size) if last else p
        return pdf

    return block


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, source, size, source_size, target, copies, taken (size * copies), nth (its number among rows of one id, source and size).

    ``copies`` is the whole part of target / source_size, or one more.  Null
    and empty texts have size 0 and can be taken too, at no cost.  A null
    source is a source of its own.  Rows stay one for one, equal rows are
    equal in chance, and the result depends on the rows and ``seed`` alone.
    A very long text is a document like any other, of which two copies at most
    are taken.  An empty table gives an empty result; where nothing has words,
    no copy is taken.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    goal = stored(targets(sources, weights=weights, share=share, most=most), "targets")
    per = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    blocks = F.ceil(F.col("docs") / F.lit(float(BLOCK)))
    # rows of one id, source and size are counted, then numbered: a group of any size is never in one place
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m")
    h = F.xxhash64("doc_id", "nth", F.lit(seed))
    shares = rows.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "nth", "rank", "source_size", "target", F.floor(per + EPS).alias("whole"),
        F.greatest(per - F.floor(per + EPS), F.lit(0.0)).alias("p"), h.alias("h"),
        F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(seed + 1)), blocks).alias("block"))
    level = (goal.agg(F.max("docs")).first()[0] or 0) / BLOCK
    done, open_ = None, shares
    while True:
        flown = open_.groupBy("rank", "block").applyInPandas(_fly(seed, level <= 1), shares.schema)
        if level <= 1:
            done = flown if done is None else done.unionByName(flown)
            break
        # two a block at most are undecided, so a level shrinks them by thousands
        flown = stored(flown, "flight")
        settled = flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        level /= BLOCK // 2
        fewer = F.lit(0) if level <= 1 else F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(int(level) + 1))
        open_ = flown.where("p > 0 and p < 1").withColumn("block", fewer.cast("long"))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "nth")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    Awkward rows as in ``mix``; of rows with one id, source and size it is not
    told which of them is taken more often.
    """
    chosen = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how).where("copies > 0")
    right = chosen.select(F.col("doc_id").alias("r_id"), F.col("source").alias("r_source"), F.col("size").alias("r_size"), "nth", "copies")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{source_col}`").alias("s"), size.alias("n"))
    left = left.withColumn("k", F.row_number().over(Window.partitionBy("i", "s", "n").orderBy(F.lit(0))))
    same = F.col("i").eqNullSafe(F.col("r_id")) & F.col("s").eqNullSafe(F.col("r_source")) & (F.col("n") == F.col("r_size")) & (F.col("k") == F.col("nth"))
    both = left.join(right, same)
    return both.select("d", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("d.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to 150 % of their words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
