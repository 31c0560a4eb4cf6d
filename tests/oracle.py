"""Compares a query with its SQL on the same Parquet tables, as sorted rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if isinstance(v, (list, dict, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def compare(df, sql: str, sf_dir: str) -> int:
    (c1, r1), (c2, r2) = spark_rows(df), sql_rows(sql, sf_dir)
    assert c1 == c2, (c1, c2)
    if r1 != r2:
        s1, s2 = set(r1), set(r2)
        raise AssertionError((len(r1), len(r2), [x for x in r1 if x not in s2][:5], [x for x in r2 if x not in s1][:5]))
    return len(r1)
