"""Comparison of a registered query with its DuckDB SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: "" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def assert_same(spark, sf_dir, query, sql):
    a, b = query(spark, sf_dir).toPandas(), duck(sf_dir, sql)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
