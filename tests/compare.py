"""Runs a registered query and its SQL on the same tables and compares rows without regard to order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(df):
    return sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())


def sql_rows(con, sql):
    got = con.sql(sql)
    at = [got.columns.index(c) for c in sorted(got.columns)]
    return sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall()), sorted(got.columns)
