import random

import pytest
from pyspark.sql import functions as F

from vecloom.operators import changes, ring, stats
from vecloom.sources import binlog


def model(nodes, backups, n=20):
    nodes = sorted(set(nodes))
    k = len(nodes)
    return {p: (nodes[p % k], [nodes[(p + b) % k] for b in range(1, backups + 1) if b < k]) for p in range(n)} if k else {}


@pytest.mark.parametrize("count", range(6))
@pytest.mark.parametrize("backups", range(4))
def test_ring_formulas(spark, count, backups):
    nodes = [f"n{i}" for i in range(count)][::-1]
    got = {r["partition_id"]: (r["owner"], r["backups"]) for r in ring.ring(spark, nodes, num_partitions=20, backup_count=backups).collect()}
    assert got == model(nodes, backups)


def test_migrations(spark):
    nodes = ["a", "b", "c"]
    before, after = model(nodes, 0), model([*nodes, "d"], 0)
    got = {r["partition_id"]: (r["old_owner"], r["new_owner"]) for r in ring.migrations_on_add(spark, nodes, "d", num_partitions=20).collect()}
    assert got == {p: (before[p][0], after[p][0]) for p in before if before[p][0] != after[p][0]}
    assert ring.migrations_on_add(spark, nodes, "a").count() == 0 == ring.migrations_on_add(spark, [], "a").count()
    less = model(["a", "c"], 0)
    got = {r["partition_id"]: r["new_owner"] for r in ring.migrations_on_remove(spark, nodes, "b", num_partitions=20).collect()}
    assert got == {p: less[p][0] for p in before if before[p][0] == "b"}
    assert ring.migrations_on_remove(spark, nodes, "x").count() == 0
    assert [r["new_owner"] for r in ring.migrations_on_remove(spark, ["a"], "a", num_partitions=2).collect()] == [None, None]


def test_ring_stats(spark):
    r = ring.ring_stats(spark, ["a", "b", "c"], num_partitions=20).first()
    assert (r["nodes"], r["min_per_node"], r["max_per_node"]) == (3, 6, 7) and abs(r["ideal_per_node"] - 20 / 3) < 1e-9
    assert ring.ring_stats(spark, []).first()["nodes"] == 0
    wide = {x["node"]: x["partitions"] for x in ring.distribution(spark, ["a", "b", "c"], num_partitions=2).collect()}
    assert wide == {"a": 1, "b": 1, "c": 0}


def test_sizes_by_node(spark):
    placed = spark.range(100).select((F.col("id") % 10).cast("int").alias("partition_id"))
    got = {r["node"]: (r["primary_vectors"], r["backup_vectors"]) for r in stats.sizes_by_node(placed, ["a", "b", "c"], num_partitions=10).collect()}
    assert sum(v[0] for v in got.values()) == 100 == sum(v[1] for v in got.values())
    assert got["a"] == (40, 30)
    assert {r["node"]: r["backup_vectors"] for r in stats.sizes_by_node(placed, ["a"], num_partitions=10).collect()} == {"a": 0}


SCHEMA = "partition_id int, version long, op string, vector_id string, embedding array<float>, metadata string"


def random_log(seed, n=300):
    rng = random.Random(seed)
    out, versions = [], {}
    for _ in range(n):
        i = rng.randrange(25)
        p = i % 4
        versions[p] = versions.get(p, 0) + 1
        gone = rng.random() < 0.3
        out.append((p, versions[p], "delete" if gone else "insert", f"v{i}", None if gone else [float(rng.random())], None if gone else '{"a":1}'))
    return out


def replay(rows):
    state = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        state.pop(r[3], None)
        if r[2] == "insert":
            state[r[3]] = (r[0], r[1])
    return state


def as_state(df):
    return {r["vector_id"]: (r["partition_id"], r["version"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_last_writer_wins_in_any_order(spark, seed):
    rows = random_log(seed)
    random.Random(9).shuffle(rows)
    assert as_state(changes.live(spark.createDataFrame(rows, SCHEMA))) == replay(rows)


@pytest.mark.parametrize("cut", [0, 1, 40, 10**6])
def test_snapshot_and_tail_lose_nothing(spark, cut):
    rows = random_log(3)
    log = spark.createDataFrame(rows, SCHEMA)
    snap = changes.compacted(None, log.where(F.col("version") <= cut))
    older = changes.compacted(None, log.where(F.col("version") <= cut // 2)).where("snapshot_version >= 0")
    assert as_state(changes.recovered(snap.unionByName(older), log)) == replay(rows)
    again = changes.compacted(snap, log.where(F.col("version") > cut))
    assert as_state(again) == replay(rows)


def test_deletes_and_replay(spark):
    log = spark.createDataFrame([(0, v, "insert", f"v{v}", [1.0], None) for v in range(1, 11)], SCHEMA)
    assert sorted(r["version"] for r in changes.replay_after(log, 7).collect()) == [8, 9, 10]
    asked = spark.createDataFrame([("v1",), ("x",)], "vector_id string")
    assert {r["vector_id"]: r["existed"] for r in changes.existed(changes.live(log), asked).collect()} == {"v1": True, "x": False}
    assert changes.without(log, asked).count() == 9
    assert [r["entries"] for r in changes.due_for_compaction(log, None, 10).collect()] == [10]
    assert changes.due_for_compaction(log, None, 11).count() == 0
    assert changes.partition_version(log, 0) == 10 and changes.partition_version(log, 5) == 0


def test_binary_log_round_trip_and_damage(spark, tmp_path):
    rows = random_log(4, 60)
    log = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "logs")
    assert binlog.write_logs(log, folder) == 4
    back = binlog.read_logs(spark, folder)
    assert len({(r["partition_id"], r["version"]) for r in back.collect()}) == 60
    assert as_state(changes.live(back)) == replay(rows)
    good = binlog.pack_entry("insert", "v-1", 1, [1, 2, 3], '{"a":1}')
    bad_json = b"\x00\x00\x00\x03{x}"
    assert [e[0] for e in binlog.entries(good + bad_json + binlog.pack_entry("delete", "v-1", 2))] == [1, 2]
    assert [e[2] for e in binlog.entries(good + good[:-1])] == ["v-1"]
    assert list(binlog.entries(b"\x7f\xff\xff\xff" + good)) == [] == list(binlog.entries(b""))


def test_binary_snapshot_round_trip_and_damage(spark, tmp_path):
    data = binlog.pack_snapshot(10, 3, [("v-0", [1, 2, 3], '{"a":1}'), ("v-1", [4, 5, 6], '{"b":2}')])
    version, dim, rows = binlog.snapshot_rows(data)
    assert (version, dim, [r[0] for r in rows], rows[1][1].tolist(), rows[0][2]) == (10, 3, ["v-0", "v-1"], [4, 5, 6], '{"a":1}')
    assert len(binlog.snapshot_rows(data[:-3])[2]) == 1
    assert binlog.snapshot_rows(b"XXXX" + data[4:]) is None and binlog.snapshot_rows(data[:10]) is None
    assert binlog.snapshot_rows(binlog.pack_snapshot(1, 0, [])) is None
    folder = str(tmp_path / "snaps")
    one = spark.createDataFrame([(3, 5, "v-0", [1.0], "{}")], "partition_id int, snapshot_version long, vector_id string, embedding array<float>, metadata string")
    two = spark.createDataFrame([(3, 10, "v-0", [2.0], "{}"), (3, 10, "v-1", [3.0], "{}")], one.schema)
    binlog.write_snapshots(two, folder)
    binlog.write_snapshots(one, folder)
    got = binlog.read_snapshots(spark, folder).collect()
    assert {(r["vector_id"], r["snapshot_version"], r["embedding"][0]) for r in got} == {("v-0", 10, 2.0), ("v-1", 10, 3.0)}
    assert binlog.storage_stats(spark, folder).first()["snapshot_files"] == 2


def test_dead_members(spark):
    beats = spark.createDataFrame([("a", 0), ("b", 7), ("c", 20)], "node_id string, s int").select("node_id", F.timestamp_seconds("s").alias("ts"))
    assert [r["node_id"] for r in stats.dead_members(beats, 13).collect()] == ["a"]
    assert {r["node_id"] for r in stats.dead_members(beats, 12.5).collect()} == {"a", "b"}


def test_held_roles(spark):
    """What a node should not hold is stale while it has rows; what it should hold and doesn't has none."""
    held = spark.createDataFrame([("a", 0, 5), ("b", 0, 5), ("c", 0, 2), ("c", 0, 1), ("c", 3, 0), ("gone", 1, 4), ("b", 1, None)], "node string, partition_id int, vectors long")
    got = {(r["node"], r["partition_id"]): (r["role"], r["vectors"]) for r in ring.held_roles(held, ["c", "b", "a"], num_partitions=4).collect()}
    want = {}
    for p, (owner, backups) in model(["a", "b", "c"], 1, 4).items():
        want |= {(owner, p): ("primary", 0)} | {(b, p): ("backup", 0) for b in backups}
    want |= {("a", 0): ("primary", 5), ("b", 0): ("backup", 5), ("c", 0): ("stale", 3), ("gone", 1): ("stale", 4)}
    assert got == want
    empty = ring.held_roles(held, [])
    assert {r["role"] for r in empty.collect()} == {"stale"} and [r["node"] for r in ring.all_nodes(spark, ["y", "x", "y"]).collect()] == ["x", "y"]
