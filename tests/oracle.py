"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    expected = Counter(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == expected, (list((got - expected))[:3], list((expected - got))[:3])
