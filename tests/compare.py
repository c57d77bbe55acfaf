"""Compares a query's rows with its oracle's in DuckDB, as sorted rows of named columns."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) and glob.glob(path) else path}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return repr(list(x)) if isinstance(x, (list, tuple)) else repr(x)


def difference(con, sql: str, df) -> str:
    """Empty if both have the same columns and rows."""
    want = con.sql(sql)
    if sorted(want.columns) != sorted(df.columns):
        return f"columns {sorted(want.columns)} and {sorted(df.columns)}"
    cols = sorted(want.columns)
    a = sorted(tuple(map(_cell, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    b = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    if a == b:
        return ""
    off = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"{len(a)} and {len(b)} rows; first differences {off}"
