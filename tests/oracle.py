"""Compares a query with its SQL in DuckDB, row by row and without regard to order."""

from __future__ import annotations

import os
from collections import Counter
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float | Decimal):
        return round(float(value), 6)
    if hasattr(value, "tzinfo") and value.tzinfo:
        return value.replace(tzinfo=None)
    return value


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
