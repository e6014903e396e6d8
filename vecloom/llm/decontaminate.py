"""Operator 9: benchmark decontamination, in DataFrame operations only.

Benchmark texts become a set of windows of ``n`` consecutive normalised words
(a shorter item is one window).  Their hashes fill a bit table of a fixed
largest size, which goes to every task as a constant; documents are scanned
inside their own row and only the positions whose window hash hits the table
leave it.  Those few are joined with the windows themselves, broadcast when
their measured size is below a bound and shuffled otherwise, and verified word
by word.  Hit words are then flagged, removed, or the document dropped.

Words of a document are compared case-folded in the scan (a superset of the
contract's A-Z folding) and exactly in the verification.

All work inside a row is linear in the text: hit words are a sorted array of
positions, whose runs are the spans, and a cut text is put together from the
slices between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import stored
from .bits import build, has, table_size

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word character once A-Z is lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: All characters of BREAKS.
BREAK_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Windows are broadcast up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows(benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of the benchmark: size, gram (words joined by spaces), key, of; and (of, item) with the items that have a window.

    Windows of the same items share ``of``, so that a hit carries a name and
    not a list of items.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(folded(F.col("text"))).alias("w")).where(F.size("w") > 0)
    spans = F.when(F.size("w") <= n, F.array(F.array_join("w", " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    )
    grams = items.select("item_id", F.least(F.size("w"), F.lit(n)).alias("size"), F.explode(spans).alias("gram"))
    listed = grams.groupBy("size", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    listed = stored(listed.withColumn("of", F.sha2(F.to_json("items"), 256)).withColumn("key", F.xxhash64("gram")), "windows")
    return listed.select("size", "gram", "key", "of"), listed.dropDuplicates(["of"]).select("of", F.explode("items").alias("item"))


def _probe_key(w: Column, at: Column, size: int) -> Column:
    """Hash of the (at most four) words that begin a window: what the bit table holds."""
    return F.xxhash64(*[F.get(w, at + i) for i in range(min(size, 4))])


def scan(docs: DataFrame, grams: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of windows in documents: id, th (the text's hash), at (0-based word), size, of, one row per (id, th, at, size).

    Only columns ``id_col`` and ``text_col`` of ``docs`` are read.
    """
    found = grams.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + 120).alias("bytes")).collect()
    sizes = {r["size"]: r["n"] for r in found}
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), words(text).alias("w"))
    tables = {}
    for size, count in sorted(sizes.items()):
        w = F.transform(F.split("gram", " "), F.lower)
        probe = grams.where(F.col("size") == size).select(_probe_key(w, F.lit(0), size).alias("h"))
        tables[size] = table_size(count), build(probe, "h", table_size(count))
    if not tables:
        return spark.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, th long, at int, size int, of string")
    scanned = base.withColumn("lw", F.transform("w", F.lower))

    def hits(size: int) -> Column:
        cells, table = tables[size]
        starts = F.when(F.size("lw") >= size, F.sequence(F.lit(0), F.size("lw") - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            F.filter(starts, lambda i: has(table, cells, _probe_key(F.col("lw"), i, size))),
            lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), folded(F.array_join(F.slice("w", i + 1, size), " ")).alias("gram")),
        )

    maybe = scanned.select("id", "th", F.explode(F.concat(*[hits(s) for s in tables])).alias("h")).select("id", "th", "h.*")
    maybe = maybe.withColumn("key", F.xxhash64("gram"))
    side = F.broadcast(grams) if sum(r["bytes"] for r in found) <= BROADCAST_BYTES else grams
    return maybe.join(side, ["key", "size", "gram"]).select("id", "th", "at", "size", "of")


def flagged(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that has a hit: id, th, n_hit, items (sorted), spans (array of struct<at, size>, merged).

    Words inside any occurrence of any window count once.  A document is known
    by its id and its text's hash ``th``, so rows of one id and other texts
    stay apart, equal rows and null ids meet.  Null and empty texts have no
    words; a very long text is scanned whole, in its own row.  Rows without a
    hit are absent; without benchmark words, or documents, it is empty.
    """
    grams, items = windows(benchmark, n)
    found = stored(scan(docs, grams, id_col=id_col, text_col=text_col), "hits")
    per = found.groupBy("id", "th").agg(F.collect_set(F.struct("at", "size")).alias("occ"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("occ", lambda o: F.sequence(o["at"], o["at"] + o["size"] - 1)))))
    per = per.select("id", "th", hit.alias("hit"))
    # a run of positions begins where the one before is missing, and ends where the next is
    first = F.filter("hit", lambda p, k: (k == 0) | (F.get("hit", k - 1) != p - 1))
    last = F.filter("hit", lambda p, k: (k == F.size("hit") - 1) | (F.get("hit", k + 1) != p + 1))
    per = per.select("id", "th", F.size("hit").cast("long").alias("n_hit"), F.zip_with(first, last, lambda a, z: F.struct(a.alias("at"), (z - a + 1).alias("size"))).alias("spans"))
    named = found.select(F.col("id").alias("i"), F.col("th").alias("t"), "of").distinct().join(items, "of")
    named = named.groupBy("i", "t").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return per.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("id", "th", "n_hit", "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, drop_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove hit spans from texts, and documents of which ``drop_share`` of the words or more are hit.

    Keeps the columns of ``docs``.  A clean document keeps its text to the
    byte; in a cut one every maximal run of hit words goes, with what stands
    between its words, and the rest, what stands before and after the run
    included, stays in place.  Null and empty texts are clean, rows without an
    id are judged by their text, repeated rows are each kept or cut, a very
    long text is cut in time that grows with its length.  Without benchmark
    words all rows stay as they are; an empty table stays empty.
    """
    hit = flagged(docs, benchmark, n=n, id_col=id_col, text_col=text_col).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias("_spans"), F.col("n_hit").alias("_n"))
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    text, key = F.col("d")[text_col], F.col("d")[id_col]
    out = body.join(hit, key.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left")
    # each word with the break before it, and the break after the last one, restore the text; only hit texts are taken apart
    upto = F.when(F.col("_n").isNotNull(), F.rtrim(text, F.lit(BREAK_CHARS)))
    pieces = F.regexp_extract_all(upto, F.lit(r"(?s)([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    out = out.select("d", "_n", "_spans", pieces.alias("_pieces"), F.substring(text, F.length(upto) + 1, F.length(text)).alias("_tail"))
    out = out.where(F.col("_n").isNull() | (F.col("_n") < F.lit(drop_share) * F.size("_pieces")))
    before = lambda p: F.regexp_extract(p, r"(?s)^([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)", 1)
    past = lambda s: s["at"] + s["size"]
    # what stands between the run before and this one, and the break that this one begins with
    kept = F.transform("_spans", lambda s, k: F.concat(
        F.array_join(F.slice("_pieces", F.coalesce(past(F.get("_spans", k - 1)), F.lit(0)) + 1, s["at"] - F.coalesce(past(F.get("_spans", k - 1)), F.lit(0))), ""),
        before(F.get("_pieces", s["at"]))))
    end = past(F.element_at("_spans", -1))
    rest = F.array_join(F.slice("_pieces", end + 1, F.size("_pieces") - end), "")
    cut = F.concat(F.array_join(kept, ""), rest, F.col("_tail"))
    return out.select(*[F.when(F.col("_n").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col("d")[c].alias(c) for c in docs.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hit = flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    sizes = docs.select("doc_id", F.xxhash64("text").alias("t"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(hit, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("th")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM grams), spots AS (
  SELECT doc_id, i AS pos, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)
), found AS (SELECT doc_id, pos, size, item_id FROM spots JOIN grams USING (size, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
