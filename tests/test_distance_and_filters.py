import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.distance import as_vector, distance
from vecloom.functions.hashing import partition_of, partition_of_id
from vecloom.functions.predicates import apply_filter, compile_filter
from vecloom.operators import knn


def brute(x, q, metric):
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric == "dot":
        return -(x @ q)
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(1))
    n = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
    return np.where(n == 0, 1.0, 1 - (x @ q) / np.where(n == 0, 1, n))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((120, 12)) * rng.uniform(0.1, 5, (120, 1))).astype(np.float32)
    x[7] = 0
    x[40] = x[3]
    x[41] = x[3]
    rows = [(f"v-{i}", [float(v) for v in x[i]]) for i in range(len(x))]
    return x, spark.createDataFrame(rows, "vector_id string, embedding array<float>").cache()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_search_is_exact(vectors, metric):
    x, df = vectors
    q = x[3]
    d = brute(x, q, metric)
    want = sorted((d[i], f"v-{i}") for i in range(len(x)))[:15]
    got = knn.search(df, q.tolist(), 15, metric=metric).collect()
    assert [r["vector_id"] for r in got] == [v for _, v in want]
    assert np.allclose([r["distance"] for r in got], [v for v, _ in want], atol=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_batch_strategies_agree(spark, vectors, metric, monkeypatch):
    """In one block, in many, and grouped in a join: the very distances of single queries, and their order."""
    x, df = vectors
    qs = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in (0, 3, 7, 11)], "query_id int, embedding array<float>")
    one = {(i, n + 1): (r.vector_id, r.distance) for i in (0, 3, 7, 11) for n, r in enumerate(knn.search(df, x[i].tolist(), 8, metric=metric).collect())}

    def batch():
        return {(r.query_id, r["rank"]): (r.vector_id, r.distance) for r in knn.search_batch(df, qs, 8, metric=metric).collect()}

    assert batch() == one
    monkeypatch.setattr(knn, "BLOCK", 17)
    assert batch() == one
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 8 * 12 * 2)
    assert batch() == one
    with pytest.raises(ValueError):
        knn.search_batch(df, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id int, embedding array<float>"), 3)
    assert knn.search_batch(df, qs.limit(0), 3).collect() == [] == knn.search_batch(df.limit(0), qs, 3).collect()


def test_equal_vectors_are_ordered_by_id(spark):
    same = spark.range(9000).select(F.col("id").alias("vector_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    qs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "query_id int, embedding array<float>")
    got = knn.search_batch(same, qs, 3).collect()
    assert sorted((r.query_id, r["rank"], r.vector_id) for r in got) == [(q, k + 1, k) for q in (1, 2) for k in range(3)]


def test_very_many_queries_in_bounded_memory(spark):
    """200,000 queries of 128 dimensions: several groups, blocks of a bounded size."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 128)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vector_id int, embedding array<float>").cache()
    turn = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.when(k == F.col("id") % 128, 1.0).otherwise(0.0).cast("float"))
    qs = spark.range(200_000).select(F.col("id").alias("query_id"), turn.alias("embedding"))
    assert knn.query_groups(qs, "query_id", "embedding")[1] == 4
    got = knn.search_batch(df, qs, 2, metric="dot").groupBy((F.col("query_id") % 128).alias("d"), "rank").agg(F.count(F.lit(1)).alias("n"), F.min("vector_id").alias("lo"), F.max("vector_id").alias("hi")).collect()
    assert sum(r.n for r in got) == 400_000
    for r in got:
        assert r.lo == r.hi == np.argsort(-x[:, r.d], kind="stable")[r["rank"] - 1]


def test_zero_vector_ties_and_short_results(spark, vectors):
    x, df = vectors
    got = knn.search(df, [0.0] * 12, 3).collect()
    assert [r["distance"] for r in got] == [1.0] * 3 and [r["vector_id"] for r in got] == ["v-0", "v-1", "v-10"]
    assert [r["vector_id"] for r in knn.search(df, x[3].tolist(), 3).collect()] == ["v-3", "v-40", "v-41"]
    assert knn.search(df, x[3].tolist(), 1000).count() == 120
    assert knn.search(df.limit(0), x[3].tolist(), 5).collect() == []
    for bad in (0, -1):
        with pytest.raises(ValueError):
            knn.search(df, x[3].tolist(), bad)
    with pytest.raises(ValueError):
        knn.search(df, x[3].tolist(), 1, metric="manhattan")


def test_wrong_dimension_fails_the_job(vectors):
    with pytest.raises(Exception, match="another length"):
        knn.checked(vectors[1], 13).collect()


def test_partition_matches_sha256(spark):
    ids = [f"v-{i}" for i in range(300)] + ["", "é", "日本"]
    df = spark.createDataFrame([(i,) for i in ids], "vector_id string").select("vector_id", partition_of(F.col("vector_id")).alias("p"), partition_of(F.col("vector_id"), 7).alias("q"))
    for r in df.collect():
        assert r["p"] == partition_of_id(r["vector_id"]) and r["q"] == partition_of_id(r["vector_id"], 7)


ROWS = [
    {"s": "Biology", "n": 2018, "x": 1.5, "b": True},
    {"s": "Physics", "n": 2020, "x": float("nan"), "b": False},
    {"s": "Math", "n": 2021, "x": 3.0, "b": None},
    {"s": None, "n": None, "x": None, "b": None},
    {"s": "2020", "n": 1, "x": 1.0, "b": True},
    {},
]


def python_match(meta, field, op, value):
    v = meta.get(field)
    if v is None:
        return False
    try:
        return {
            "eq": lambda: v == value, "ne": lambda: v != value, "gt": lambda: v > value, "gte": lambda: v >= value,
            "lt": lambda: v < value, "lte": lambda: v <= value, "in": lambda: v in value,
        }[op]()
    except TypeError:
        return False


SPECS = [(f, op, v) for f in ("s", "n", "x", "b", "none") for op in ("eq", "ne", "gt", "gte", "lt", "lte") for v in ("Math", "2020", 2020, 1, 1.5, True, False, None)]
SPECS += [("s", "in", ["Biology", "Math"]), ("s", "in", []), ("s", "in", "Mathematics and Biology"), ("n", "in", [2018, 2020]), ("n", "in", {2018: 1}), ("x", "in", [1, 3]), ("b", "in", [1])]


@pytest.mark.parametrize("variant", [False, True])
def test_filters_follow_python(spark, variant):
    import json

    typed = "i int, m struct<s:string, n:bigint, x:double, b:boolean>"
    df = spark.createDataFrame([(i, tuple(r.get(k) for k in "snxb")) for i, r in enumerate(ROWS)], typed)
    if variant:
        text = [(i, json.dumps({k: v for k, v in r.items() if not (isinstance(v, float) and math.isnan(v))})) for i, r in enumerate(ROWS)]
        df = spark.createDataFrame(text, "i int, t string").select("i", F.parse_json("t").alias("m"))
    exprs = [F.coalesce(compile_filter({"field": f, "op": op, "value": v}, df, "m"), F.lit(False)).alias(f"c{k}") for k, (f, op, v) in enumerate(SPECS)]
    got = {r["i"]: r for r in df.select("i", *exprs).collect()}
    for i, meta in enumerate(ROWS):
        if variant:
            meta = {k: v for k, v in meta.items() if not (isinstance(v, float) and math.isnan(v))}
        for k, (f, op, v) in enumerate(SPECS):
            assert got[i][f"c{k}"] == python_match(meta, f, op, v), (meta, f, op, v)


def test_filter_forms(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, None)], "i int, `d.k` string")
    count = lambda spec: apply_filter(df, spec, None).count()
    assert count(None) == 2 and count([]) == 2
    assert count({"field": "d.k", "op": "eq", "value": "a.b"}) == 1
    assert count([{"field": "i", "op": "gt", "value": 0}, {"field": "i", "op": "lt", "value": 2}]) == 1
    assert count(lambda m: m["i"] == 2) == 1
    for bad in ({}, {"field": "i"}, {"op": "eq"}, {"field": "i", "op": "like", "value": 1}, 7, "x", [3]):
        with pytest.raises(ValueError):
            compile_filter(bad, df, None)


def test_struct_filter_reaches_the_scan(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), F.struct(F.col("id").alias("year"), F.lit("x").alias("cat")).alias("metadata"))
    df.write.parquet(str(tmp_path / "t"))
    plan = apply_filter(spark.read.parquet(str(tmp_path / "t")), {"field": "year", "op": "gt", "value": 5})._jdf.queryExecution().executedPlan().toString()
    assert "metadata.year" in plan.split("PushedFilters")[1].split("]")[0]
    assert as_vector([1, 2]) is not None and distance(F.array(F.lit(1.0)), F.array(F.lit(1.0))) is not None


def test_embedding_from_a_model(spark):
    from vecloom.functions.embedding import with_embedding

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i int, t string")
    got = {r["i"]: r["embedding"] for r in with_embedding(df, lambda: lambda xs: [[len(x), 1.0] for x in xs], 2, input_col="t").collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: [0.0, 1.0]}
    with pytest.raises(Exception, match="another length"):
        with_embedding(df, lambda: lambda xs: [[1.0] for _ in xs], 2, input_col="t").collect()
