"""Compares a Spark result with DuckDB's as multisets of rows."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sql, folder):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = c.execute(sql)
    return rows_of([x[0] for x in got.description], got.fetchall())


def compare(df, sql, folder):
    names, want = duck(sql, folder)
    own, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert own == names, (own, names)
    assert got == want, (len(list(got.elements())), len(list(want.elements())), list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
