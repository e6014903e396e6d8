"""Rows of a Spark result and of the same tables' SQL in DuckDB, in one form."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def rows(frame) -> list[tuple]:
    """Columns by name, floats to six digits, rows sorted."""
    names = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(str, map(clean, r))) for r in frame[names].itertuples(index=False, name=None))


def assert_same(query, sql: str, spark, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
