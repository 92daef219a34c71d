"""Comparison of a query with its SQL in DuckDB, as sorted rows with floats to nine digits."""
import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(sf + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
    return c


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


def same(df, con, sql):
    cols = sorted(df.columns)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    b = sorted((tuple(norm(x[names.index(k)]) for k in cols) for x in r.fetchall()), key=repr)
    a = sorted((tuple(norm(x[k]) for k in cols) for x in df.collect()), key=repr)
    assert a == b
