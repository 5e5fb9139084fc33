"""Runs a query and its SQL over the same tables and compares rows, whatever their order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(spark, c, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cursor.fetchall())
    assert len(got) == len(want)
    assert got == want
    return len(got)
