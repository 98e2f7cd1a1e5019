"""Comparing a query with its SQL."""

import glob
import os

import duckdb


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(_plain(r[c]) for c in cols)) for r in df.collect())


def sql_rows(sql, directory):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    got = con.sql(sql)
    cols = sorted(got.columns)
    at = [got.columns.index(c) for c in cols]
    return cols, sorted(repr(tuple(_plain(r[i]) for i in at)) for r in got.fetchall())
