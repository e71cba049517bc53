"""Compares a query with its SQL, as rows without order."""

import os

import duckdb
import pandas as pd


def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v).removesuffix(" 00:00:00")


def rows(frame: pd.DataFrame) -> list:
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark_frame, duck_frame) -> None:
    a, b = spark_frame.toPandas(), duck_frame
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
