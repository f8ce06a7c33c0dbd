"""Compares a query with its SQL on the same tables."""

import collections
import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(repr(tuple(plain(r[i]) for i in order)) for r in records)


def same(spark, d, query, sql):
    df = query(spark, d)
    rel = duck(d).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])
