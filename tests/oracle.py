"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    return round(v, 5) if isinstance(v, float) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    ours = _sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = _sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
