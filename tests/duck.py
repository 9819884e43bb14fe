"""Comparing query results with DuckDB's."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def views(folder: str = SF):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, decimal.Decimal):
        return float(x)
    return x.isoformat() if hasattr(x, "isoformat") else x


def same(df, sql: str, folder: str = SF) -> int:
    """Assert equal rows in any order; their number."""
    r = views(folder).execute(sql)
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(v) for v in row]) for row in r.fetchall())
    got = sorted(repr([plain(row[c]) for c in cols]) for row in df.collect())
    assert got == want
    return len(got)
