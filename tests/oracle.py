"""Compare a query with its SQL in DuckDB, columns by name, rows in any order."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb
import numpy as np

TINY = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, np.bool_)):
        return None if v is None else bool(v)
    if isinstance(v, (int, float, decimal.Decimal, np.integer, np.floating)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple, np.ndarray)) else str(v)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-7 * max(abs(a), abs(b), 1e-6)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


def rows(data) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    assert columns == sorted(df.columns)
    got = rows(df.select(*columns).collect())
    want = rows(con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(map(close, a, b)), (columns, a, b)
