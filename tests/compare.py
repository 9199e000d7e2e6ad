"""Side-by-side run of a registered query and its SQL twin."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        assert not math.isnan(value), "NaN must not leak into results"
        assert not (value == 0 and math.copysign(1, value) < 0), "negative zero"
        return float(value)
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, db) -> list[str]:
    """Empty when columns, rows and values agree."""
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    ours = _bag(df.columns, df.collect())
    theirs = _bag(names, cursor.fetchall())
    only_ours, only_theirs = ours - theirs, theirs - ours
    if not only_ours and not only_theirs:
        return []
    return [
        f"{sum(ours.values())} rows against {sum(theirs.values())}; {sum(only_ours.values())} differ",
        f"ours {list(only_ours)[:2]}",
        f"twin {list(only_theirs)[:2]}",
    ]
