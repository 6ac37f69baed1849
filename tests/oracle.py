"""Comparison of a query's rows with an independent engine's."""

import math
import os

import duckdb

from millrace.session import TABLES


def connect(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(names, found, columns):
    at = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, connection, sql):
    names = sorted(df.columns)
    answer = connection.sql(sql)
    assert sorted(answer.columns) == names
    got, want = rows(names, [tuple(r) for r in df.collect()], df.columns), rows(names, answer.fetchall(), answer.columns)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, wrong[:3]
