from vecloom.operators import knn
from vecloom.plans import catalog


def test_whole_query_sets(spark, sf):
    """Every id that 20 divides asks, not the first ids only."""
    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert max(ids) >= 400
    for name in ("knn_batch", "knn_batch_euclidean", "knn_batch_grouped", "recall_at_k", "ann_lsh", "ann_hnsw"):
        assert {r["query_id"] for r in catalog.queries()[name](spark, sf).select("query_id").distinct().collect()} == ids, name


def test_recall_of_the_whole_query_set(spark, sf, monkeypatch):
    """At least 0.9, filtered too, and the same in many groups of queries."""
    whole = {r["strategy"]: r["recall"] for r in catalog.queries()["ann_recall"](spark, sf).collect()}
    assert set(whole) == {"lsh", "hnsw", "lsh filtered", "hnsw filtered"} and min(whole.values()) >= 0.9, whole
    one = {name: sorted(map(tuple, find(spark, sf).collect())) for name, find in (("lsh", catalog._lsh), ("hnsw", catalog._hnsw))}
    monkeypatch.setattr(knn, "BROADCAST_BYTES", catalog._dim(spark, sf) * 8 * 10)
    assert one == {name: sorted(map(tuple, find(spark, sf).collect())) for name, find in (("lsh", catalog._lsh), ("hnsw", catalog._hnsw))}
