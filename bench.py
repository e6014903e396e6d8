"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its figure is the median
of the three, in seconds, for a full evaluation of its result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "knn_cosine", "knn_euclidean", "knn_dot", "knn_filter_and", "knn_batch", "knn_batch_grouped", "knn_scatter_gather",
    "partition_counts", "node_stats", "log_upsert_lww", "snapshot_plus_tail", "ann_lsh", "recall_at_k", "latency_percentiles",
)
RUNS = 3


def recipe(spark: SparkSession, rows: int, asked: int, dim: int = 128, k: int = 10) -> dict:
    """Seeded Gaussian rows of unit length in a collection: bulk and single writes a second, latency of ``Collection.search``
    (rows held on the driver, and as a Spark job), batched queries a second, recall; every one of the recipe's queries is asked."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from vecloom import collection
    from vecloom.collection import Collection

    rng = np.random.default_rng(42)
    x = rng.standard_normal((rows, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = rng.standard_normal((asked, dim)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    base = f"{spark.conf.get('spark.checkpoint.dir')}/recipe-{rows}"
    spark.range(1).write.parquet(f"{base}/first")
    pq.write_table(pa.table({"vector_id": [f"v-{i}" for i in range(rows)], "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{base}/rows.parquet")
    c = Collection(spark, f"{base}/c", dim=dim, snapshot_interval=10**9)
    t = time.perf_counter()
    c.put_many(spark.read.parquet(f"{base}/rows.parquet"))
    insert = time.perf_counter() - t
    truth = np.argsort(1 - q.astype(float) @ x.T.astype(float), axis=1, kind="stable")[:, :k]
    out = {"rows": rows, "dim": dim, "queries": asked}
    for name, cells in (("", collection.LOCAL_CELLS), ("job_", 0)):
        kept, collection.LOCAL_CELLS = collection.LOCAL_CELLS, cells
        c._held = c._asked = None
        # the first call is a job, the second reads the rows that the driver holds
        for _ in range(2):
            c.search(q[0].tolist(), k).collect()
        lat, hits = [], 0
        # all of the recipe's queries; the same question as a Spark job is asked ten times, for comparison
        for i in range(asked if cells else 10):
            t = time.perf_counter()
            got = c.search(q[i].tolist(), k).collect()
            lat.append((time.perf_counter() - t) * 1000)
            hits += len({r["vector_id"] for r in got} & {f"v-{j}" for j in truth[i]})
        collection.LOCAL_CELLS = kept
        lat.sort()
        out |= {f"{name}recall": hits / (k * len(lat)), f"{name}avg_ms": round(sum(lat) / len(lat), 1), f"{name}p95_ms": round(float(np.percentile(lat, 95)), 1), f"{name}single_qps": round(1000 * len(lat) / sum(lat), 1)}
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(asked)], "query_id int, embedding array<float>")
    c.search_batch(queries, k).count()
    t = time.perf_counter()
    c.search_batch(queries, k).select(F.count("*")).collect()
    out["batch_qps"] = round(asked / (time.perf_counter() - t), 1)
    t = time.perf_counter()
    for i in range(3):
        c.put(f"one-{i}", x[i].tolist())
    return out | {"inserts_per_s": round(rows / insert), "single_put_ms": round((time.perf_counter() - t) * 1000 / 3)}


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("vecloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vecloom-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vecloom.plans.catalog import queries

    known, took, warm = queries(), {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            t = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        warm[name], took[name] = round(times[0], 4), round(statistics.median(times[1:]), 4)
    recipes = [recipe(spark, n, a) for n, a in ((1_000, 100), (5_000, 100), (10_000, 50))]
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "first_run": warm,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": RUNS, "warm_up_runs": 1, "recipe": recipes,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
