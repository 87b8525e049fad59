"""Comparison of a Spark result with DuckDB over the same tables."""

import decimal
import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(folder=DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    return value


def same(df, sql, con):
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=repr)
    assert got == expected
    return len(got)
