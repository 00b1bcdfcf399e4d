"""Spark results against DuckDB's, column by column, rows in any order."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(f)[:-8]}\" AS SELECT * FROM read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):  # a whole number with nulls beside it is a float in one of the two
        return str(int(v)) if v.is_integer() else repr(float(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


def same(spark_df, con, sql):
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
