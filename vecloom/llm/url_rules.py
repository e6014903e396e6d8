"""Operator 7: URL rules by a sort-merge range join, in DataFrame operations only.

A host becomes a canonical key by reversing its labels (``a.example.org`` is
``org.example.a.``).  A rule's host then covers an interval of keys, its own
and every subdomain's, and intervals of two rules are nested or disjoint.  The
borders of all intervals cut the key space into segments; each segment carries
the stack of rules that are open in it.  Pages and borders are sorted together
and one sweep hands every page the last stack before it.  The stack's deepest
rule whose path starts the page's path decides.

The sweep runs in many sorted lanes.  A lane holds whole groups of hosts, those
of one pair of last labels (``org.example.``), and their borders.  A group with
more pages than a lane should have is dealt to several lanes, and its borders
go to each of them; only borders of one-label rules (``org``) go to every lane.
The groups so dealt are found by counting and are fewer than there are lanes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import stored

#: (verdict, rule): a rule is a host and a path, written together.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def host_group(key: Column) -> Column:
    """The first two labels of a key, or all of a shorter one."""
    return F.regexp_extract(key, r"(?s)^([^.]*\.[^.]*\.|.*$)", 1)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules as rows: rule, verdict, host, path."""
    text = json.dumps([{"verdict": v, "rule": r} for v, r in rules])
    df = spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<verdict:string,rule:string>>")))
    at = F.locate("/", F.col("rule"))
    host = F.when(at > 0, F.expr("substring(rule, 1, locate('/', rule) - 1)")).otherwise(F.col("rule"))
    path = F.when(at > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit(""))
    return df.select("rule", "verdict", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def segments(rules: DataFrame) -> DataFrame:
    """Borders of the rules' intervals in key order: (key, stack).

    ``stack`` holds the rules open from this border to the next one.  The
    interval of prefix ``p.`` ends before ``p/``, the character after the dot.
    """
    keyed = rules.select(
        host_key(F.col("host")).alias("lo"),
        F.struct(F.length("host").alias("host_len"), F.length("path").alias("path_len"), "rule", "verdict", "host", "path").alias("r"),
    ).where("lo <> ''")
    stacks = keyed.groupBy("lo").agg(F.collect_list("r").alias("rs"))
    # intervals nest by labels, so the rules open at a border are those of its key's label prefixes:
    # at an interval's start its own and its ancestors', past its end its ancestors' only
    labels = F.split(F.expr("substring(lo, 1, length(lo) - 1)"), r"\.")
    starts = keyed.select(F.col("lo").alias("key"), labels.alias("l"), F.size(labels).alias("deep")).distinct()
    ends = starts.select(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), "l", (F.col("deep") - 1).alias("deep"))
    prefixes = F.transform(F.sequence(F.lit(0), F.col("deep")), lambda k: F.concat(F.array_join(F.slice("l", 1, k), "."), F.lit(".")))
    open_at = starts.unionByName(ends).select("key", F.explode(prefixes).alias("lo"))
    return (
        open_at.join(stacks, "lo", "left").groupBy("key")
        .agg(F.sort_array(F.flatten(F.collect_list("rs"))).alias("stack"))
    )


def apply_rules(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                default_verdict: str = "allow", lanes: int | None = None) -> DataFrame:
    """Judge every url by the longest fitting rule.

    Returns all columns of ``pages`` plus host, path, rule, verdict (existing
    columns of those names are replaced).  A null url, or one without
    ``://``, has an empty host and path, fits no rule and gets
    ``default_verdict``; so does an empty url, and a very long one is judged
    like any other.  Rules without a host fit nothing.  Repeated ids and
    repeated rows, without an id too, are each judged and kept, and dealt one
    by one where there are many.  Equal rules: the later in (rule, verdict)
    order wins.  Without rules every page gets the default; an empty table
    stays empty.
    """
    spark = pages.sparkSession
    lanes = lanes or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    groups = pages.select(host_group(host_key(url_host(url))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    # groups of more than their share of the rows: fewer than there are lanes
    fair = max(1, -(-total // lanes))
    hot = stored(groups.where(F.col("n") > fair).select(F.col("g").alias("h_g"), F.ceil(F.col("n") / F.lit(float(fair))).cast("int").alias("parts")), "hot")

    def lane(group: Column, part: Column) -> Column:
        return F.pmod(F.xxhash64(group, part), F.lit(lanes)).cast("int")

    body = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page"), url_host(url).alias("host"), url_path(url).alias("path"),
        F.xxhash64(F.col(f"`{id_col}`"), url, F.monotonically_increasing_id()).alias("deal"))
    body = body.withColumn("key", host_key(F.col("host"))).withColumn("g", host_group(F.col("key")))
    body = body.join(F.broadcast(hot), F.col("g") == F.col("h_g"), "left")
    part = F.coalesce(F.pmod("deal", F.col("parts").cast("long")).cast("int"), F.lit(0))
    body = body.select(lane(F.col("g"), part).alias("lane"), "key", F.lit(1).alias("is_page"), "page", "host", "path")
    marks = segments(rules).withColumn("g", host_group(F.regexp_replace("key", "/$", "."))).join(F.broadcast(hot), F.col("g") == F.col("h_g"), "left")
    one_label = F.regexp_count("g", F.lit(r"\.")) < 2
    parts = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda k: lane(F.col("g"), k))
    to = F.when(one_label, F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(F.array_distinct(parts))
    marks = marks.select(F.explode(to).alias("lane"), "key", F.lit(0).alias("is_page"), "stack")
    swept = body.unionByName(marks, allowMissingColumns=True).withColumn(
        "open", F.last("stack", ignorenulls=True).over(
            Window.partitionBy("lane").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).where("is_page = 1")
    fits = F.filter("open", lambda r: F.col("path").startswith(r["path"]))
    best = swept.withColumn("best", F.array_max(fits))
    return best.select(
        "page.*", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default_verdict)).alias("verdict"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the fixed rules for every page: page_id, host, path, rule, verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rule, host, path) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
         ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
