import pytest

from vecloom.plans import catalog

from .duck import assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(catalog.queries()[name], SQL[name], spark, sf)


def test_approximate_queries(spark, sf):
    assert set(catalog.queries()) - set(SQL) == {"ann_lsh", "ann_hnsw", "ann_lsh_filtered", "ann_hnsw_filtered", "ann_recall", "ann_layer_stats"}
    odd = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("label % 2 = 1").select("vec_id").collect()}
    for name in ("ann_lsh_filtered", "ann_hnsw_filtered"):
        assert {r["vec_id"] for r in catalog.queries()[name](spark, sf).collect()} <= odd


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
