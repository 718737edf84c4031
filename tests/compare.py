"""A query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_match(spark, query, sql, data=DATA):
    df = query(spark, data)
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    names = sorted(df.columns)
    mine = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    at = [found.columns.index(n) for n in names]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert mine == theirs
