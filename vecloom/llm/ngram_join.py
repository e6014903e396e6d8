"""Operator 1: n-gram Jaccard join with rare-first prefixes.

1. Every text becomes its set of word n-grams, as 64-bit hashes.  Texts that
   are the same sequence of words (128 bits of BLAKE2 over the words) are one
   class member: the smallest id stands for it.
2. Grams are counted over all documents.  The global order puts common grams
   last, by count, and all others by hash.  Any order that depends on the gram
   alone gives exact results; this one keeps common passages out of prefixes.
   Counts reach the workers as a table of one byte (eight steps an octave) for
   each range of hashes, of 64 MB at most.
3. Two sets can only link if they share a gram in their prefixes.  Each set
   posts its prefix grams; the length filter, the positional filter and the
   suffix filter (a lower bound of the difference of what follows the shared
   gram in either set, from the parities of 64 cells, and one of the whole
   sets, from 512) drop pairs.
4. Within a gram's postings neighbours are paired in a few orders, verified,
   and joined to components.  Then every pair that still lies in two different
   components is generated and verified.  Pairs inside one component need no
   more: the component is known.  A large group of near copies so costs a few
   verifications per member, not one per pair, and no link between components
   is lost.  Postings of a hot gram are dealt to cells of some HOT postings; in
   the last step only those outside the gram's largest component go to all its
   cells.
5. Verification reads both whole texts, once per pair (pairs tried before are
   left out), intersects the sets and compares the words of equal hashes byte
   by byte: no link rests on a hash alone.
6. Classes are all that ``near_duplicates`` needs.  ``near_links`` and
   ``link_counts`` give every link: all pairs of different sets of a component
   are intersected, in pairs of blocks dealt by a hash of the id, so that a
   large component is many small tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import scope, stored
from .bits import build, has, table_size
from .components import components
from .textkernels import Shingler, pieces, same_grams, trim, utf8

#: Cells of the table of counts: two to this power at most, a byte each (a bound of the broadcast).
MOST_BITS = 26
#: A gram in fewer sets is never called common.
LEAST_COMMON = 8
#: Steps of a count's rank for each doubling.
STEPS = 8
#: Postings of a gram that meet in one place, about.
HOT = 1024
#: Grams per bucket of the count, and texts' grams counted at once by a worker.
BUCKET_GRAMS, COUNTED = 1 << 19, 1 << 20

#: A set's sketch: the parities of its counts in 512 cells.
PARITIES = [f"g{k}" for k in range(8)]
SETS = "doc_id long, n int, sid long, sid2 long, " + ", ".join(f"{c} long" for c in PARITIES)
#: Neighbours paired in an order of a gram's postings, and the number of random orders.
REACH, ORDERS = 2, 3
#: Sets, and grams of sets, of a block of a component, about; columns of an incidence matrix at once.
BLOCK, BLOCK_GRAMS, COLUMNS = 256, 1 << 19, 1 << 14


def _per_text(grams: np.ndarray, bound: np.ndarray, values: np.ndarray, how: np.ufunc) -> np.ndarray:
    """``how`` over each text's values; 0 for a text without grams."""
    out = np.zeros(len(bound) - 1, values.dtype)
    full = np.diff(bound) > 0
    if full.any():
        out[full] = how.reduceat(values, bound[:-1][full])
    return out


def _set_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            raw, off = utf8(batch.column(1))
            ids = batch.column(0)
            for i, j, data, own in pieces(raw, off):
                grams, bound, sums = shingler.sets(data, own, True)
                n = np.diff(bound)
                text = np.repeat(np.arange(j - i), n)
                odd = np.bincount(text * 512 + (grams >> np.uint64(3) & np.uint64(511)).astype(np.int64), minlength=512 * (j - i)) & 1
                g = np.packbits(odd.astype(np.uint8).reshape(-1, 512), axis=1).view(np.int64)
                yield pa.record_batch(
                    [ids.slice(i, j - i), pa.array(n.astype(np.int32)), pa.array(np.ascontiguousarray(sums[:, 0])), pa.array(np.ascontiguousarray(sums[:, 1])),
                     *(pa.array(np.ascontiguousarray(g[:, k])) for k in range(8))],
                    ["doc_id", "n", "sid", "sid2", *PARITIES])

    return rows


def _new_sets(grams: np.ndarray, bound: np.ndarray, sums: np.ndarray, seen: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those sets that this worker hasn't met in this share: grams, bounds, first halves of digests."""
    n = np.diff(bound)
    fresh = np.zeros(len(n), bool)
    for k, s in enumerate(map(tuple, sums.tolist())):
        if n[k] and s not in seen:
            seen.add(s)
            fresh[k] = True
    if len(seen) > 1 << 19:
        seen.clear()
    keep = np.repeat(fresh, n)
    return grams[keep], np.concatenate([[0], np.cumsum(n[fresh])]), sums[fresh, 0]


#: Grams are counted by their highest 54 bits: six by the bucket's number or more, 48 stored.
KEY_SHIFT = 10


def _count_rows(width: int, bits: int):
    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(parts) >> np.uint64(KEY_SHIFT), return_counts=True)
        cut = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(54 - bits))
        low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        used = [b for b in range(1 << bits) if cut[b + 1] > cut[b]]
        counts = counts.astype("<u4")
        return pa.record_batch(
            [pa.array(used, pa.int32()), pa.array([low[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary()),
             pa.array([counts[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary())], ["bucket", "keys", "counts"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, parts, held = Shingler(width), set(), [], 0
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for _, _, data, own in pieces(raw, off):
                grams, _, _ = _new_sets(*shingler.sets(data, own, True), seen)
                parts.append(grams)
                held += len(grams)
                if held >= COUNTED:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)
            del parts
        trim()

    return rows


def _merge_counts(bits: int, least: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, 6)
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, :6] = low
        keys = keys.view("<u8").ravel()
        counts = np.frombuffer(b"".join(pdf["counts"]), "<u4")
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, first) if len(first) else counts
        common = total >= least
        top = np.int64(int(pdf["bucket"].iloc[0]) >> (bits - 6)) << np.int64(48)
        return pd.DataFrame({"key": keys[first][common].astype(np.int64) | top, "df": total[common]})

    return merge


def common_grams(docs: DataFrame, width: int, total: int) -> DataFrame:
    """(key, df) of grams in LEAST_COMMON sets or more, counted over all documents."""
    bits = 6
    while total >> bits > BUCKET_GRAMS and bits < 30:
        bits += 1
    rows = docs.select("text").mapInArrow(_count_rows(width, bits), "bucket int, keys binary, counts binary")
    return stored(rows.groupBy("bucket").applyInPandas(_merge_counts(bits, LEAST_COMMON), "key long, df long"), "grams")


def _rank_table(grams: DataFrame) -> np.ndarray:
    """A byte for each range of hashes: 0, or STEPS times the logarithm of the largest count of a common gram in it.

    The table has eight ranges for each common gram, up to the bound; beyond,
    more rare grams share a range with a common one and go later in the order.
    That moves work, not results.
    """
    count = grams.count()
    bits = 10
    while count << 3 > 1 << bits and bits < MOST_BITS:
        bits += 1
    low = min(bits, 16)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        ranks = np.zeros(1 << low, np.uint8)
        np.maximum.at(ranks, pdf["cell"].to_numpy(np.int64) & ((1 << low) - 1), pdf["rank"].to_numpy(np.uint8))
        return pd.DataFrame({"part": [int(pdf["cell"].iloc[0]) >> low], "ranks": [ranks.tobytes()]})

    rank = F.least(F.floor(F.lit(float(STEPS)) * F.log2("df")), F.lit(255)).cast("int")
    cells = grams.select(F.shiftright("key", 64 - KEY_SHIFT - bits).alias("cell"), rank.alias("rank")).groupBy("cell").agg(F.max("rank").alias("rank"))
    table = np.zeros(1 << bits, np.uint8)
    for r in cells.groupBy(F.shiftright("cell", low)).applyInPandas(part, "part long, ranks binary").toLocalIterator():
        table[r["part"] << low:(r["part"] + 1) << low] = np.frombuffer(r["ranks"], np.uint8)
    return table


POSTS = "gram long, sid long, n int, pos int, tail long, cells int"


def _posting_rows(width: int, num: int, den: int, common):
    def tails(cell: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Parities, in 64 cells, of what follows each gram in its set."""
        bit = np.uint64(1) << cell
        upto = np.bitwise_xor.accumulate(bit)
        whole = np.repeat(upto[bound[1:] - 1], np.diff(bound))
        return whole ^ upto

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), set()
        ranks = common.value
        shift = np.uint64(64 - int(len(ranks)).bit_length() + 1)
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for _, _, data, own in pieces(raw, off):
                grams, bound, sid = _new_sets(*shingler.sets(data, own, True), seen)
                if not len(grams):
                    continue
                n = np.diff(bound)
                text = np.repeat(np.arange(len(n)), n)
                rank = ranks[(grams >> shift).astype(np.int64)]
                for t in np.flatnonzero(_per_text(grams, bound, rank > 0, np.logical_or)).tolist():
                    a, b = bound[t], bound[t + 1]
                    order = np.argsort(rank[a:b], kind="stable")
                    grams[a:b], rank[a:b] = grams[a:b][order], rank[a:b][order]
                tail = tails(grams >> np.uint64(20) & np.uint64(63), bound)
                pos = np.arange(len(grams)) - bound[:-1][text]
                take = pos < (n - (-(-num * n // den)) + 1)[text]
                cells = np.maximum(2.0 ** (rank[take] / STEPS) / HOT, 1).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(grams[take].view(np.int64)), pa.array(sid[text[take]]), pa.array(n[text[take]].astype(np.int32)),
                     pa.array(pos[take].astype(np.int32)), pa.array(tail[take].view(np.int64)), pa.array(cells)], ["gram", "sid", "n", "pos", "tail", "cells"])
        trim()

    return rows


def _verify_rows(width: int, num: int, den: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        last, x = None, None
        for batch in batches:
            (ra, oa), (rb, ob) = utf8(batch.column("ta")), utf8(batch.column("tb"))
            hit = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                a = ra[oa[k]:oa[k + 1]]
                key = a.tobytes()
                if key != last:
                    last, x = key, shingler.detail(a)
                y = shingler.detail(rb[ob[k]:ob[k + 1]])
                both = len(x[0]) + len(y[0])
                least = -(-num * both // (num + den))
                hit[k] = len(x[0]) > 0 and same_grams(x, y, least) >= max(least, 1)
            keep = pa.array(hit)
            yield pa.record_batch([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])
        trim()

    return rows


def _verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (u, v) of ids whose whole texts link."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    ends = ends.select("doc_id", F.xxhash64("doc_id").alias("h"))
    size = table_size(2 * pairs.count(), 16)
    table = build(ends, "h", size)
    texts = docs.where(has(table, size, F.xxhash64("doc_id"))).select("doc_id", "text")
    first = pairs.join(texts.withColumnRenamed("text", "ta"), F.col("u") == F.col("doc_id")).drop("doc_id")
    both = first.join(texts.withColumnRenamed("text", "tb"), F.col("v") == F.col("doc_id")).drop("doc_id")
    return stored(both.select("u", "v", "ta", "tb").mapInArrow(_verify_rows(width, num, den), "u long, v long"), "links")


def _difference(a: Column, b: Column) -> Column:
    """Lower bound of the whole sets' difference: a cell's parities differ only
    if one set has a gram there that the other hasn't.  It tells sets of up to
    some 1,500 grams apart; longer ones pass it."""
    odd = F.lit(0)
    for k in PARITIES:
        odd = odd + F.bit_count(a[k].bitwiseXOR(b[k]))
    return odd


#: Columns that tell a set from others.
SAME = ["sid", "sid2", "n"]


def _members(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """Each row's set with its representative; null for a text without grams."""
    return sets.join(reps.select(*SAME, "rep"), SAME, "left")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")


def _cell(x: Column, salt: int, cells: Column) -> Column:
    """The place of a posting among those of its gram, dealt anew for each salt."""
    return F.when(cells == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(x, F.lit(salt)), cells.cast("long")).cast("int"))


def _postings(docs: DataFrame, reps: DataFrame, width: int, num: int, den: int, total: int) -> DataFrame:
    """Prefix grams that more than one set may have: gram, cells, x (rep, n, pos, tail, sketch)."""
    spark = docs.sparkSession
    grams = common_grams(docs, width, total)
    common = spark.sparkContext.broadcast(_rank_table(grams))
    posts = docs.select("text").mapInArrow(_posting_rows(width, num, den, common), POSTS)
    in_order = Window.partitionBy("gram", _cell(F.col("sid"), -1, F.col("cells"))).orderBy("n", "sid", "pos")
    near = posts.select("*", F.lag("sid").over(in_order).alias("before"), F.lead("sid").over(in_order).alias("after"))
    # a run of one set (exact copies in several shares post it again) keeps its ends next to other sets only
    near = near.where("before <> sid or after <> sid or cells > 1")
    info = reps.select(F.col("sid").alias("r_sid"), F.col("n").alias("r_n"), "rep", *PARITIES)
    alone = stored(near.select("gram", "sid", "n", "pos", "tail", "cells"), "shared").distinct()
    whole = F.struct("rep", "n", "pos", "tail", *PARITIES)
    return stored(alone.join(info, (F.col("sid") == F.col("r_sid")) & (F.col("n") == F.col("r_n"))).select("gram", "cells", whole.alias("x")), "postings")


def _chains(posted: DataFrame, orders: list[int | None], may_link) -> DataFrame:
    """Pairs of near neighbours, of two components, in a gram's postings: by length, or dealt and ordered by a hash."""
    out = None
    for salt in orders:
        order = ["x.n", "x.rep"] if salt is None else [F.xxhash64("x.rep", F.lit(salt))]
        w = Window.partitionBy("gram", _cell(F.col("x.rep"), -2 if salt is None else salt, F.col("cells"))).orderBy(*order)
        me = F.struct("x", "comp")
        near = posted.select(me.alias("b"), F.array(*[F.lag(me, k).over(w) for k in range(1, REACH + 1)]).alias("as_"))
        # one filter after the explosion: written out for each neighbour it is too long for the JVM to compile
        pair = near.select("b", F.explode("as_").alias("a")).where("a is not null and a.comp <> b.comp")
        pair = pair.where(may_link(F.col("a.x"), F.col("b.x"))).select(F.col("a.x.rep").alias("x"), F.col("b.x.rep").alias("y"))
        out = pair if out is None else out.unionByName(pair)
    return out


def _apart(placed: DataFrame, num: int, den: int, may_link) -> DataFrame:
    """All pairs of postings of one gram that lie in different components and pass the filters.

    One of two such postings is outside the gram's largest component: those
    go to all cells of the gram and to the two neighbouring bands of length,
    the others stay where they are.
    """
    # two sets whose lengths let them link lie in one band or in neighbouring ones
    if num >= den:
        band = lambda n: n
    else:
        wide = float(np.log(den / num)) * (1 + 1e-9)
        band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(wide)).cast("int")
    reach = F.lit(0) if num >= den else F.lit(1)
    by_comp = placed.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("c"), F.first("cells").alias("cells"))
    tops = by_comp.groupBy("gram").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.first("cells").alias("cells")).where("comps > 1")
    tops = tops.select(F.col("gram").alias("t_gram"), "top", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("t_cell"))
    rows = placed.withColumn("cell", _cell(F.col("x.rep"), -3, F.col("cells")))
    rows = rows.join(tops, (F.col("gram") == F.col("t_gram")) & (F.col("cell") == F.col("t_cell"))).select("gram", "cells", "cell", "x", "comp", "top", band(F.col("x.n")).alias("band"))
    rows = stored(rows, "apart")
    few = rows.where("comp <> top").select(
        F.col("gram").alias("b_gram"), F.col("x").alias("b"), F.col("comp").alias("b_comp"), "cells",
        F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)).alias("b_band"))
    few = few.select("b_gram", "b", "b_comp", "b_band", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("b_cell"))
    a, b = F.col("x"), F.col("b")
    prefix = lambda x: x["pos"] < x["n"] - F.ceil(F.lit(2 * num) * x["n"].cast("long") / F.lit(float(num + den)) - F.lit(1e-9)) + 1
    # the shorter set's shared gram stands in a still shorter prefix
    a_first = (a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["rep"] < b["rep"]))
    meet = (F.col("gram") == F.col("b_gram")) & (F.col("cell") == F.col("b_cell")) & (F.col("band") == F.col("b_band")) & (F.col("comp") != F.col("b_comp"))
    found = rows.join(few, meet & F.when(a_first, prefix(a)).otherwise(prefix(b)) & may_link(a, b))
    return found.select(a["rep"].alias("x"), b["rep"].alias("y"))


def _classes(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts' sets, the sets' representatives, and (u, root) of the representatives' components; ``docs`` as ``_named``."""
    with scope(docs.sparkSession) as own:
        sets = stored(docs.mapInArrow(_set_rows(width), SETS), "sets")
        total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
        reps = sets.where("n > 0").groupBy(*SAME).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in PARITIES])
        reps = stored(reps, "reps")
        shared = _postings(docs, reps, width, num, den, total)

        need = lambda a, b: F.ceil(F.lit(num) * (a["n"] + b["n"]).cast("long") / F.lit(float(num + den)) - F.lit(1e-9))

        def may_link(a: Column, b: Column) -> Column:
            """Length, positional and suffix filters for two sets whose first shared gram this is."""
            rest_a, rest_b = a["n"] - a["pos"] - 1, b["n"] - b["pos"] - 1
            return (
                (F.lit(den) * F.least(a["n"], b["n"]).cast("long") >= F.lit(num) * F.greatest(a["n"], b["n"]).cast("long"))
                & (F.least(rest_a, rest_b) + 1 >= need(a, b))
                & (F.bit_count(a["tail"].bitwiseXOR(b["tail"])) <= rest_a + rest_b - 2 * (need(a, b) - 1))
                & (_difference(a, b) <= a["n"] + b["n"] - 2 * need(a, b))
            )

        def new_pairs(df: DataFrame, tried: DataFrame | None) -> DataFrame:
            pairs = df.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct()
            return stored(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")

        placed, links, tried, roots = shared.withColumn("comp", F.col("x.rep")), None, None, None
        # a second look at what the first left apart joins most of a large group before all its pairs are tried
        for orders in ([None, *range(ORDERS)], list(range(ORDERS, 2 * ORDERS))):
            pairs = new_pairs(_chains(placed, orders, may_link), tried)
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = _verified(pairs, docs, width, num, den)
            links = found if links is None else links.unionByName(found)
            roots = components(links)
            placed = shared.join(roots, F.col("x.rep") == roots["u"], "left").select("gram", "cells", "x", F.coalesce("root", "x.rep").alias("comp"))
            mixed_up = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("cells").alias("cells")).where("lo < hi")
            mixed_up = mixed_up.select(F.col("gram").alias("m_gram"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("m_cell"))
            mine = _cell(F.col("x.rep"), -3, F.col("cells"))
            placed = stored(placed.join(mixed_up, (F.col("gram") == F.col("m_gram")) & (mine == F.col("m_cell")), "left_semi"), "placed")
        rest = new_pairs(_apart(placed, num, den, may_link), tried)
        more = _verified(rest, docs, width, num, den)
        if not more.isEmpty():
            roots = components(links.unionByName(more))
        own.keep(sets, reps, roots)
    return sets, reps, roots


def near_duplicates(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two texts link when ``den`` * intersection >= ``num`` * union of their sets
    of ``width``-word shingles (A-Z folded, words split at white space).  A text
    with fewer words is one shingle; null, empty and blank texts have none and
    link with nothing, each its own component.  Ids are whole numbers; rows
    with a null id are left out of the result, repeated ids count as one text
    (their rows are each returned).  Other columns are not read.  An empty
    table gives an empty result.  A very long text is one row like any other:
    its postings are bounded by its own length, and a pair of very long texts
    is verified whole.  Ties don't matter: a component is named by its least id.
    """
    sets, reps, roots = _classes(_named(docs, id_col, text_col), width, num, den)
    return (
        _members(sets, reps).join(roots, F.col("rep") == roots["u"], "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))
    )


def _gram_rows(width: int):
    """Each text's grams as one value; the digest tells which rows of a repeated id are meant."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            for i, j, data, own in pieces(raw, off):
                grams, bound, sums = shingler.sets(data, own, True)
                held = [grams[a:b].tobytes() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
                right = pa.array(sums[:, 0] == batch.column("sid").slice(i, j - i).to_numpy())
                part = batch.slice(i, j - i)
                out = [part.column(c) for c in ("comp", "rep", "sid", "copies", "blocks", "own")]
                yield pa.record_batch([*out, pa.array(held, pa.binary())], ["comp", "rep", "sid", "copies", "blocks", "own", "grams"]).filter(right)
        trim()

    return rows


def _shared_grams(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    sizes = np.array([len(x) for x in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(sets)), sizes), (np.cumsum(often > 1) - 1)[at]
    keep = often[at] > 1
    order = np.argsort(column[keep], kind="stable")
    row, column = row[keep][order], column[keep][order]
    total = np.zeros((len(sets), len(sets)))
    for low in range(0, int((often > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        has_it = np.zeros((len(sets), int(column[b - 1]) - low + 1), np.float32)
        has_it[row[a:b], column[a:b] - low] = 1
        total += has_it @ has_it.T
    return total.astype(np.int64)


def _link_rows(num: int, den: int, counted: bool):
    """Links between the sets of two blocks, or within one, as pairs or as each set's number of linked documents.

    Rows come sorted by component and pair of blocks.
    """

    def links(run: dict[tuple[int, int], tuple]) -> pa.RecordBatch:
        who = list(run.values())
        grams = [np.frombuffer(r[3], np.uint64) for r in who]
        own, size = np.array([r[2] for r in who]), np.array([len(g) for g in grams])
        shared = _shared_grams(grams)
        hit = (shared > 0) & (den * shared >= num * (size[:, None] + size[None, :] - shared))
        two = own.min() != own.max()
        u, v = np.nonzero(np.triu(hit, 1) & ((own[:, None] != own[None, :]) if two else True))
        rep, copies = np.array([r[0] for r in who]), np.array([r[1] for r in who])
        other = rep[u] != rep[v]
        u, v = u[other], v[other]
        if not counted:
            return pa.record_batch([pa.array(np.minimum(rep[u], rep[v])), pa.array(np.maximum(rep[u], rep[v])), pa.array(shared[u, v])], ["u", "v", "n_shared"])
        n = np.bincount(u, copies[v], len(who)) + np.bincount(v, copies[u], len(who))
        return pa.record_batch([pa.array(rep), pa.array(np.array([s for _, s in run])), pa.array(n.astype(np.int64))], ["rep", "sid", "n_links"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = None, {}
        for batch in batches:
            for comp, i, j, rep, sid, copies, own, grams in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "rep", "sid", "copies", "own", "grams"))):
                # two blocks are compared with each other here, and each with itself in a run of its own
                if (comp, i, j) != last:
                    if len(run) > 1 and (last[1] == last[2] or len({r[2] for r in run.values()}) > 1):
                        yield links(run)
                    last, run = (comp, i, j), {}
                run[rep, sid] = (rep, copies, own, grams)
        if len(run) > 1 and (last[1] == last[2] or len({r[2] for r in run.values()}) > 1):
            yield links(run)
        trim()

    return rows


def _links(docs: DataFrame, members: DataFrame, reps: DataFrame, roots: DataFrame, width: int, num: int, den: int, counted: bool) -> DataFrame:
    copies = members.where("rep is not null").groupBy(F.col("rep").alias("c_rep"), F.col("sid").alias("c_sid")).agg(F.count_distinct("doc_id").alias("copies"))
    placed = reps.select("rep", "sid", "n").join(roots, F.col("rep") == roots["u"], "left").select("rep", "sid", "n", F.coalesce("root", "rep").alias("comp"))
    placed = stored(placed, "members")
    sizes = placed.groupBy(F.col("comp").alias("s_comp")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n").cast("long")).alias("grams")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / F.lit(float(BLOCK))), F.least("m", F.ceil(F.col("grams") / F.lit(float(BLOCK_GRAMS)))))
    placed = placed.join(sizes, F.col("comp") == F.col("s_comp")).select("comp", "rep", "sid", blocks.cast("int").alias("blocks"))
    placed = placed.join(copies, (F.col("rep") == F.col("c_rep")) & (F.col("sid") == F.col("c_sid"))).drop("c_rep", "c_sid")
    placed = stored(placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")), "blocks")
    size = table_size(placed.count(), 16)
    table = build(placed.select(F.xxhash64("rep").alias("h")), "h", size)
    texts = docs.where(has(table, size, F.xxhash64("doc_id")))
    asked = placed.join(texts, F.col("rep") == F.col("doc_id")).select("comp", "rep", "sid", "copies", "blocks", "own", "text")
    held = stored(asked.mapInArrow(_gram_rows(width), "comp long, rep long, sid long, copies long, blocks int, own int, grams binary"), "held")
    other = held.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o"))
    dealt = other.select("comp", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "rep", "sid", "copies", "own", "grams")
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return dealt.mapInArrow(_link_rows(num, den, counted), "rep long, sid long, n_links long" if counted else "u long, v long, n_shared long")


def near_links(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link: (u, v, n_shared) between the representatives of different sets, u < v, and (id, representative_id) of every text with a set.

    Two texts of different sets link when their representatives do, and all
    texts of one set link.  Rules and awkward rows as in ``near_duplicates``.
    """
    docs = _named(docs, id_col, text_col)
    sets, reps, roots = _classes(docs, width, num, den)
    members = _members(sets, reps)
    pairs = _links(docs, members, reps, roots, width, num, den, False)
    return pairs, members.where("rep is not null").select("doc_id", F.col("rep").alias("representative_id")).distinct()


def link_counts(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, component_id, n_links (other documents that it links with itself, exact copies among them).

    Half of the sum over a component is the component's number of links.  No
    pair leaves the task that verifies it.
    """
    docs = _named(docs, id_col, text_col)
    sets, reps, roots = _classes(docs, width, num, den)
    members = stored(_members(sets, reps).select("doc_id", "rep", "sid"), "membership")
    others = _links(docs, members, reps, roots, width, num, den, True).groupBy(F.col("rep").alias("o_rep"), F.col("sid").alias("o_sid")).agg(F.sum("n_links").alias("others"))
    own = members.where("rep is not null").groupBy(F.col("rep").alias("c_rep"), F.col("sid").alias("c_sid")).agg((F.count_distinct("doc_id") - 1).alias("own"))
    found = own.join(others, (F.col("c_rep") == F.col("o_rep")) & (F.col("c_sid") == F.col("o_sid")), "left").select("c_rep", "c_sid", (F.col("own") + F.coalesce("others", F.lit(0))).alias("n_links"))
    got = members.join(found, (F.col("rep") == F.col("c_rep")) & (F.col("sid") == F.col("c_sid")), "left").join(roots, F.col("rep") == roots["u"], "left")
    return got.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Documents that are the smallest id of their component, with all their columns; rows without an id stay."""
    id_col = how.get("id_col", "doc_id")
    found = near_duplicates(docs, **how).where("component_id = doc_id").select(F.col("doc_id").alias("_kept")).distinct()
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    key = F.col("d")[id_col]
    kept = body.where(key.isNotNull()).join(found, key == F.col("_kept"), "left_semi")
    return kept.unionByName(body.where(key.isNull())).select("d.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at 85 % Jaccard of 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=85, den=100)


def op1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of links of every document, by the rule of ``op1_ngram_join``."""
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=85, den=100)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, sa.n, sb.n
  HAVING 100 * count(*) >= 85 * (sa.n + sb.n - count(*))
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) r ON r.u = d.doc_id
"""

OP1_LINKS_SQL = OP1_SQL[:OP1_SQL.index("SELECT d.doc_id")] + """\
SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(k, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN (SELECT u, count(*) AS k FROM links GROUP BY u) l ON l.u = d.doc_id LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) r ON r.u = d.doc_id
"""
