import random

import numpy as np
import pytest

from vecloom.llm import mixing
from vecloom.llm.mixing import flight, landing, mix, mixed_documents

from .cases import edgy, none


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        goal = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return {**capped, **goal}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("block", [8192, 64])
def test_mix_meets_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(4)
    names = ["a", "b", "é", "Z", None, "hot"]
    rows = [(i, " ".join("w" * 1 for _ in range(int(rng.paretovariate(0.9)) % 3000)), rng.choices(names, [5, 2, 1, 1, 1, 10])[0]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sums = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    want = filled(sums)
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sums[s]} and all(abs(r["target"] - want[s]) < 1e-6 * want[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(3, 0.002 * want[s])
        assert abs(sum(r["copies"] for r in mine) - want[s] / sums[s] * len(mine)) <= 12
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = {r["doc_id"]: r["taken"] for r in mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    taken = mixed_documents(df)
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, s = rng.random(500), rng.integers(0, 900, 500).astype(float)
    out = flight(p, s, random.Random(1))
    assert ((out == 0) | (out == 1)).sum() >= 498
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * s).sum() - (p * s).sum()) < 1e-5
    assert set(landing(out, s)) <= {0.0, 1.0}
    counts = sum(flight(np.full(20, 0.3), np.arange(20.0), random.Random(k)).round() for k in range(400)) / 400
    assert abs(counts.mean() - 0.3) < 0.02 and counts.max() < 0.45 and counts.min() > 0.15
    assert flight(np.array([0.5] * 6), np.zeros(6), random.Random(1)).sum() == pytest.approx(3)


def test_edges(spark):
    df = edgy(spark)
    got = mix(df)
    assert got.count() == df.count() and all(r["taken"] <= 2 * r["size"] for r in got.collect())
    out = mixed_documents(df)
    assert out.columns == df.columns
    assert mix(none(spark)).collect() == [] == mixed_documents(none(spark)).collect()
    blank = df.where("doc_id in (2, 3, 4)")
    assert {(r["taken"], r["copies"]) for r in mix(blank).collect()} == {(0, 0)}


def test_repeated_rows_are_dealt_to_many_blocks(spark, monkeypatch):
    """Rows without an id, all alike: no block holds more than its share, and the words still come near the target."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(None, "three words here", "a")] * 1000 + [(i, "w " * (i % 9), "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    a = [r for r in got if r["source"] == "a"]
    assert len(got) == 2000 and len(a) == 1000 and abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 3
    assert sorted(r["nth"] for r in a) == list(range(1, 1001))
    blocks = spark.createDataFrame([(k,) for k in range(1, 1001)], "nth long").selectExpr("pmod(xxhash64(cast(null as bigint), 3L, nth, 3), 16) as b").groupBy("b").count().collect()
    assert max(r["count"] for r in blocks) < 128
    assert mixed_documents(df).count() == sum(r["copies"] for r in got)
