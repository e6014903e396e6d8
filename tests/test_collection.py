import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.collection import Collection
from vecloom.operators import ann, knn
from vecloom.streaming.ingest import ingest, silent_members


def rows(spark, x, start=0, meta=None):
    data = [(f"v-{start + i}", [float(v) for v in x[i]], meta(start + i) if meta else None) for i in range(len(x))]
    return spark.createDataFrame(data, "vector_id string, embedding array<float>, metadata string")


def test_put_get_delete(spark, tmp_path):
    with Collection(spark, str(tmp_path / "c"), dim=4) as c:
        c.put("a", [1, 2, 3, 4], {"title": "x", "n": 1})
        c.put("b", [1, 0, 0, 0])
        assert c.get("a") == ([1, 2, 3, 4], {"title": "x", "n": 1})
        assert c.get("nope") is None and c.size() == 2
        c.put("a", [9, 9, 9, 9])
        assert c.get("a") == ([9, 9, 9, 9], {})
        assert c.delete("a") is True and c.delete("a") is False and c.size() == 1
        c.put("a", [1, 1, 1, 1])
        assert c.contains("a") and c.size() == 2
        with pytest.raises(ValueError):
            c.put("z", [1, 2])
        with pytest.raises(ValueError):
            c.search([1, 2], 3)
        with pytest.raises(ValueError):
            c.search([1, 2, 3, 4], 0)
        with pytest.raises(ValueError):
            c.search([1, 2, 3, 4], 1, where={"field": "x"})
        with pytest.raises(ValueError):
            Collection(spark, str(tmp_path / "d"), dim=4, strategy="magic")
        with pytest.raises(Exception, match="another length"):
            c.put_many(spark.createDataFrame([("q", [1.0])], "vector_id string, embedding array<float>"))
        assert c.size() == 2


def test_empty_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), dim=3)
    assert c.size() == 0 and c.search([1, 2, 3]).collect() == [] and c.get("a") is None
    df, version = c.export_partition(5)
    assert df.count() == 0 and version == 0


def test_restart_and_crash_keep_everything(spark, tmp_path):
    x = np.random.default_rng(42).standard_normal((150, 8)).astype(np.float32)
    path = str(tmp_path / "c")
    c = Collection(spark, path, dim=8, num_partitions=7, snapshot_interval=100)
    c.put_many(rows(spark, x[:100], meta=lambda i: f'{{"i": {i}}}'))
    assert c.store.snapshots() and not c.store.segments()
    c.put_many(rows(spark, x[100:], 100))
    c.delete("v-3")
    again = Collection(spark, path, dim=8, num_partitions=7)
    assert again.size() == 149 and again.get("v-3") is None and again.get("v-120")[0] == x[120].tolist()
    near = [r["vector_id"] for r in again.search(x[5].tolist(), 10).collect()]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit.astype(float) @ unit[5].astype(float)
    assert near == [f"v-{i}" for i in sorted((i for i in range(150) if i != 3), key=lambda i: (d[i], f"v-{i}"))[:10]]
    before = {r["partition_id"]: r["version"] for r in again.store.versions().collect()}
    again.close()
    third = Collection(spark, path, dim=8, num_partitions=7)
    assert third.size() == 149 and {r["partition_id"]: r["version"] for r in third.store.versions().collect()} == before
    third.put("v-3", x[3].tolist())
    assert third.get("v-3")[0] == x[3].tolist()


def test_unfinished_writes_are_invisible(spark, tmp_path):
    import shutil

    path = str(tmp_path / "c")
    c = Collection(spark, path, dim=1)
    c.put("a", [1.0])
    shutil.copytree(f"{path}/log/seg=1", f"{path}/log/seg=2")
    (tmp_path / "c/log/seg=2/_SUCCESS").unlink()
    assert c.store.segments() == [1] and c.size() == 1


def test_versions_survive_a_crash_before_their_table(spark, tmp_path):
    import shutil

    path = str(tmp_path / "c")
    c = Collection(spark, path, dim=1, num_partitions=1)
    c.put("a", [1.0])
    c.put("b", [2.0])
    shutil.rmtree(f"{path}/versions/seg=2")
    again = Collection(spark, path, dim=1, num_partitions=1)
    assert again.export_partition(0)[1] == 2
    again.compact()
    assert again.export_partition(0)[1] == 2 and again.size() == 2
    again.put("b", [3.0])
    assert again.export_partition(0)[1] == 3 and again.get("b")[0] == [3.0] and again.size() == 2


def test_only_the_tail_is_replayed(spark, tmp_path):
    """After compaction a scan has no shuffle; with a tail the snapshot's rows don't go through the aggregation."""
    c = Collection(spark, str(tmp_path / "c"), dim=1, num_partitions=3)
    c.put_many(spark.range(50).select(F.concat(F.lit("v"), "id").alias("vector_id"), F.array(F.col("id").cast("float")).alias("embedding")))
    c.compact()
    assert "Exchange" not in c.scan()._jdf.queryExecution().executedPlan().toString()
    c.delete("v3")
    c.put("v4", [44.0])
    got = {r["vector_id"]: r["embedding"][0] for r in c.scan().collect()}
    assert len(got) == 49 and "v3" not in got and got["v4"] == 44.0


HARBOURS = T.StructType([T.StructField("harbour", T.StringType()), T.StructField("depth", T.LongType()), T.StructField("toll", T.DoubleType())])


def ships(spark, n=150, dim=9):
    """Vectors with struct metadata, some of it missing."""
    x = np.random.default_rng(77).uniform(-1, 1, (n, dim)).astype(np.float32)
    meta = [(None if i % 11 == 0 else ("Oslo", "Bergen", "Narvik")[i * i % 3], 3 + i * 7 % 20, i / 8) for i in range(n)]
    kind = T.StructType([T.StructField("vector_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", HARBOURS)])
    return x, meta, spark.createDataFrame([(f"ship/{i}", [float(v) for v in x[i]], meta[i]) for i in range(n)], kind)


def nearest(x, q, ids, k):
    d = [1 - float(x[i].astype(float) @ q.astype(float)) / float(np.linalg.norm(x[i].astype(float)) * np.linalg.norm(q.astype(float))) for i in ids]
    return [i for _, _, i in sorted((round(v, 12), f"ship/{i}", i) for v, i in zip(d, ids))][:k]


SPECS = [
    ({"field": "harbour", "op": "eq", "value": "Bergen"}, lambda m: m[0] == "Bergen"),
    ({"field": "harbour", "op": "in", "value": ["Oslo", "Narvik"]}, lambda m: m[0] in ("Oslo", "Narvik")),
    ([{"field": "depth", "op": "gte", "value": 9}, {"field": "toll", "op": "lt", "value": 12.5}], lambda m: m[1] >= 9 and m[2] < 12.5),
    ({"field": "harbour", "op": "eq", "value": "Kiel"}, lambda m: False),
    (lambda m: m.get("harbour") is not None and m["depth"] % 2 == 0, lambda m: m[0] is not None and m[1] % 2 == 0),
]


@pytest.mark.parametrize("strategy", ["exact", "lsh", "hnsw"])
def test_filters(spark, tmp_path, strategy):
    """Filters come before the choice of the nearest, whatever the strategy."""
    x, meta, df = ships(spark)
    c = Collection(spark, str(tmp_path / "c"), dim=9, num_partitions=4, metadata=HARBOURS, strategy=strategy)
    c.put_many(df)
    for spec, test in SPECS:
        allowed = [i for i in range(len(x)) if test(meta[i])]
        got = [r["vector_id"] for r in c.search(x[13].tolist(), 6, where=spec).collect()]
        want = [f"ship/{i}" for i in nearest(x, x[13], allowed, 6)]
        if strategy == "exact":
            assert got == want
        else:
            assert len(got) == len(want) and {int(v[5:]) for v in got} <= set(allowed) and len(set(got) & set(want)) >= len(want) - 1


def test_nodes_and_partitions(spark, tmp_path):
    _, _, df = ships(spark)
    c = Collection(spark, str(tmp_path / "c"), dim=9, num_partitions=8, nodes=["west", "east", "north"], metadata=HARBOURS)
    c.put_many(df)
    sizes = c.stats().collect()
    assert sum(r["primary_vectors"] for r in sizes) == 150 == sum(r["backup_vectors"] for r in sizes)
    assert sum(c.local_size(n) for n in ("west", "east", "north")) == 150 and c.local_size("south") == 0
    assert c.partition_ids().count() == 8 and c.node_partitions("north").count() == 3
    rows_, version = c.export_partition(5)
    own = rows_.count()
    assert own == version > 0
    assert c.rebuild_partition(5) and not c.rebuild_partition(8) and not c.rebuild_partition(-1) and c.size() == 150
    assert c.remove_partition(5) == own and c.remove_partition(5) == 0 and c.size() == 150 - own
    assert c.export_partition(5)[1] == 2 * own


def test_graphs_follow_writes(spark, tmp_path):
    """Rows put, put anew or deleted after the graphs were built, and after a compaction; one partition is rebuilt alone."""
    x, _, df = ships(spark)
    c = Collection(spark, str(tmp_path / "c"), dim=9, num_partitions=3, metadata=HARBOURS, strategy="hnsw")
    c.put_many(df.where("vector_id <> 'ship/20'"))
    built = c.graphs()
    c.put_many(df.where("vector_id = 'ship/20'"))
    c.put_many(df.where("vector_id = 'ship/30'").withColumn("embedding", F.transform("embedding", lambda v: -v)))
    c.delete("ship/40")

    def first(i):
        return c.search(x[i].tolist(), 1).first()["vector_id"]

    for _ in range(2):
        assert first(20) == "ship/20" and first(30) != "ship/30" and first(40) != "ship/40" and first(50) == "ship/50"
        assert c.search((-x[30]).tolist(), 1).first()["vector_id"] == "ship/30"
        c.compact()
    assert c.graphs() is built
    pids = {r["partition_id"] for r in c.scan().where("vector_id in ('ship/20', 'ship/30')").collect()}
    for p in pids:
        assert c.rebuild_partition(p)
    assert first(20) == "ship/20" and first(40) != "ship/40" and c.graphs().count() == 3


@pytest.mark.parametrize("struct", [True, False])
def test_held_rows_answer_like_jobs(spark, tmp_path, struct):
    x, _, df = ships(spark)
    c = Collection(spark, str(tmp_path / "c"), dim=9, num_partitions=5, nodes=["b", "a"], metadata=HARBOURS if struct else None)
    c.put_many(df if struct else df.withColumn("metadata", F.to_json("metadata")))
    before = [c.search(x[i].tolist(), 7).collect() for i in (0,)]
    assert c._held is None
    held = [c.search(x[i].tolist(), 7) for i in (0, 5)]
    assert len(c._held) > 1
    show = lambda rows: [(r["vector_id"], r["distance"], r["metadata"] if struct else r["metadata"].toPython(), r["partition_id"], r["source_node"]) for r in rows]
    assert show(held[0].collect()) == show(before[0])
    c.delete("ship/0")
    assert c.search(x[0].tolist(), 1).first()["vector_id"] != "ship/0"
    assert Collection(spark, str(tmp_path / "e"), dim=2).search([1, 2]).collect() == []


def test_approximate_strategies(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((400, 16)).astype(np.float32)
    df = rows(spark, x).drop("metadata")
    qs = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(20)], "query_id int, embedding array<float>")
    exact = knn.search_batch(df, qs, 10).cache()
    graphs = ann.build_graphs(df, shard_rows=150)
    assert graphs.count() == 3
    found = ann.search_graphs(graphs, qs, 10, ef=100)
    assert knn.recall_at_k(exact, found, 10).agg(F.avg("recall")).first()[0] >= 0.95
    assert knn.recall_at_k(exact, ann.search_lsh(df, qs, 10, 16), 10).agg(F.avg("recall")).first()[0] >= 0.9
    g = ann.Graph(x, "euclidean")
    allowed = np.arange(400) % 4 == 0
    got = g.search(x[1], 5, allowed=allowed)
    assert all(allowed[i] for i in got) and g.search(x[1], 1)[0] == 1
    assert ann.Graph.load(g.dump()).search(x[9], 5) == g.search(x[9], 5)
    assert ann.Graph(np.zeros((0, 4)), "cosine").search(np.ones(4), 3) == []
    for strategy in ("lsh", "hnsw"):
        c = Collection(spark, str(tmp_path / strategy), dim=16, strategy=strategy)
        c.put_many(df)
        assert c.search(x[8].tolist(), 3).first()["vector_id"] == "v-8"


@pytest.mark.parametrize("files", [1, 4])
def test_stream_ingest_equals_batch(spark, tmp_path, files):
    rng = np.random.default_rng(5)
    log = [(int(v), f"v{rng.integers(12)}", "delete" if rng.random() < 0.3 else "insert", [float(v)]) for v in rng.permutation(120)]
    schema = "version long, vector_id string, op string, embedding array<float>"
    spark.createDataFrame(log, schema).repartition(files).write.parquet(str(tmp_path / "in"))
    c = Collection(spark, str(tmp_path / "c"), dim=1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, c, str(tmp_path / "cp")).awaitTermination()
    want = {}
    for v, i, op, x in sorted(log):
        want.pop(i, None)
        if op == "insert":
            want[i] = x
    assert {r["vector_id"]: r["embedding"] for r in c.scan().collect()} == want


def test_latest_is_one_of_ties_by_rule(spark):
    """Equal versions, in any order of the rows: the same entry; a delete wins; equal rows are one."""
    from vecloom.operators.changes import DELETE, INSERT, latest

    log = [("a", 3, INSERT, [float(i)]) for i in range(6)] + [("b", 1, INSERT, [1.0])] * 3 + [("c", 2, INSERT, [5.0]), ("c", 2, DELETE, None), ("d", 9, INSERT, [2.0]), ("d", 8, DELETE, None)]
    got = set()
    for turn in range(4):
        rows = log[turn * 3:] + log[:turn * 3]
        df = spark.createDataFrame(rows, "vector_id string, version long, op string, embedding array<float>").repartition(turn + 1)
        got.add(str(sorted(map(tuple, latest(df).collect()))))
    assert len(got) == 1
    last = {r["vector_id"]: r for r in latest(df).collect()}
    assert len(last) == 4 and last["c"]["op"] == DELETE and last["d"]["embedding"] == [2.0] and latest(df).count() == 4


def test_what_a_stream_took_is_folded(spark, tmp_path, monkeypatch):
    from vecloom.streaming import ingest as module

    monkeypatch.setattr(module, "FOLDED", 2)
    schema = "version long, vector_id string, op string, embedding array<float>"
    for part, rows in enumerate([[(5, "a"), (1, "b")], [(3, "a")], [(4, "a"), (2, "b")], [(6, "c")], [(7, "a"), (0, "c")]]):
        spark.createDataFrame([(v, i, "insert", [float(v)]) for v, i in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c = Collection(spark, str(tmp_path / "c"), dim=1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, c, str(tmp_path / "cp")).awaitTermination()
    assert {r["vector_id"]: r["embedding"] for r in c.scan().collect()} == {"a": [7.0], "b": [2.0], "c": [6.0]}
    assert c.store._done("taken", "base") == [3] and c.store._done("taken", "batch") == [4]


def test_silent_members_stream(spark, tmp_path):
    beats = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "node_id string, s int").select("node_id", F.timestamp_seconds("s").alias("ts"))
    beats.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(beats.schema).parquet(str(tmp_path / "in"))
    q = silent_members(stream, 300).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="400 milliseconds").start()
    try:
        import time

        end = time.time() + 60
        while time.time() < end and spark.table("silent").count() < 2:
            time.sleep(0.5)
        got = {r["node_id"]: r["last_seen"].second for r in spark.table("silent").collect()}
    finally:
        q.stop()
    assert got == {"a": 3, "b": 2}


def test_appends_are_numbered_in_ranges(spark, tmp_path):
    """Places within partitions without a gap, in order, the same from ranges as from a window; a hot id is split over ranges."""
    c = Collection(spark, str(tmp_path / "c"), dim=2, num_partitions=3, nodes=["n"], snapshot_interval=10**9)
    c.put_many(rows(spark, np.zeros((5, 2))))
    had = {r["partition_id"]: r["version"] for r in c.store.versions().collect()}
    data = [("hot" if i % 3 == 0 else f"w-{i % 200}", [float(i), 1.0], "{}", i) for i in range(900)]
    df = spark.createDataFrame(data, "vector_id string, embedding array<float>, metadata string, turn int").repartition(7)
    placed = c._body(df, "turn").withColumn("partition_id", F.pmod(F.xxhash64("vector_id"), F.lit(3)).cast("int"))
    placed = placed.withColumn("partition_id", F.when(F.col("vector_id") != "w-1", F.col("partition_id")))  # a null partition counts from 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = c._numbered(placed, False)
        assert ranged.select("_range").distinct().count() > 1 and ranged.where("vector_id = 'hot'").select("_range").distinct().count() > 1
        took = lambda df: sorted((r["partition_id"] if r["partition_id"] is not None else -1, r["version"], r["vector_id"], r["embedding"][0]) for r in df.collect())
        got = took(ranged)
        assert got == took(c._numbered(placed, True))
        for p in (-1, 0, 1, 2):
            own = [(v, x) for q, v, _, x in got if q == p]
            first = had.get(p, 0) + 1
            assert [v for v, _ in own] == list(range(first, first + len(own))) and [x for _, x in own] == sorted(x for _, x in own)
        assert c.put_many(df, order="turn") == 900
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert c.get("hot")[0] == [897.0, 1.0] and c.size() == 5 + len({r[0] for r in data})
    assert c.put_many(df.limit(0)) == 0
