"""Spark result against DuckDB's on the same tables, regardless of order."""

import datetime
import decimal
import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return f"{v.isoformat()}T00:00:00"
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


def database(sf=SF):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def both(con, df, sql):
    cols = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    return got, sorted(([norm(r[i]) for i in at] for r in rel.fetchall()), key=repr)
