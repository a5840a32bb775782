"""Compare registered queries with their SQL oracles (DuckDB)."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def _kind(v) -> str:
    return type(v).__name__


def difference(spark, con, sf_dir: str, entry) -> str | None:
    """None when equal, otherwise a short description."""
    df = entry.query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order_a = sorted(range(len(names)), key=lambda i: df.columns[i])
    order_b = sorted(range(len(names)), key=lambda i: names[i])
    a = Counter(tuple(_cell(r[i]) for i in order_a) for r in ours)
    b = Counter(tuple(_cell(r[i]) for i in order_b) for r in theirs)
    if a != b:
        extra, missing = list((a - b).elements()), list((b - a).elements())
        return (
            f"rows {len(ours)} vs {len(theirs)}; only here {len(extra)} {sorted(extra, key=str)[:2]}; "
            f"only oracle {len(missing)} {sorted(missing, key=str)[:2]}"
        )
    if ours:
        kinds = [
            (sorted(names)[c], x, y)
            for c in range(len(names))
            for x in [{_kind(r[order_a[c]]) for r in ours} - {"NoneType"}]
            for y in [{_kind(r[order_b[c]]) for r in theirs} - {"NoneType"}]
            if x != y
        ]
        if kinds:
            return f"types {kinds}"
    return None
