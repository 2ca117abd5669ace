"""Comparing a query with its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(norm, r)) for r in frame[columns].itertuples(index=False)), key=repr)


def assert_same(spark, con, sf_dir, query, sql):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
