"""Spark and DuckDB results side by side."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, c, query, sql: str, d: str) -> None:
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = c.execute(sql)
    want = rows([x[0] for x in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(x[0] for x in cur.description)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
