"""Runs a query and its DuckDB twin over the same tables and compares their rows."""

from __future__ import annotations

import datetime
import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(x, bool) or x is None:
        return x
    return float(x) if isinstance(x, int) else str(x)


def rows(columns: list[str], found: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differences(spark, name: str, queries: dict, oracles: dict, sf_dir: str = DATA) -> str:
    """What differs, or nothing."""
    df = queries[name](spark, sf_dir)
    ours = rows(df.columns, df.collect())
    if name not in oracles:
        return ""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(oracles[name])
    columns = [c[0] for c in cur.description]
    theirs = rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours != theirs:
        a, b = [x for x in ours if x not in theirs[:5000]][:2], [x for x in theirs if x not in ours[:5000]][:2]
        return f"{len(ours)} and {len(theirs)} rows; only ours {a}; only theirs {b}"
    return ""
