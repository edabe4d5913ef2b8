"""Compare a Spark result with a DuckDB oracle, rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return float(f"{float(v):.6g}")
    return v


def oracle(sql: str, folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = c.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def assert_same(df, sql: str, folder: str) -> None:
    names, rows = oracle(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert [tuple(float(f"{float(x):.6g}") if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in got] == [
        tuple(float(f"{float(x):.6g}") if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in want
    ]
