"""Compares a query with its SQL in DuckDB over the tables of a folder."""

import glob
import math
import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_duck(con, sql):
    found = con.sql(sql)
    at = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def assert_same(spark_df, con, sql):
    names, rows = rows_of_spark(spark_df)
    want_names, want = rows_of_duck(con, sql)
    assert names == want_names
    assert len(rows) == len(want)
    assert rows == want
