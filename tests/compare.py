"""Row-for-row comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and not math.isnan(value):
        return ("number", value + 0.0)
    return (type(value).__name__, value)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when names, types of the values, and rows agree."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = normal(names, cursor.fetchall())
    ours = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if ours == theirs:
        return None
    left, right = set(map(repr, ours)) - set(map(repr, theirs)), set(map(repr, theirs)) - set(map(repr, ours))
    return f"rows {len(ours)} vs {len(theirs)}; only ours {sorted(left)[:2]}; only theirs {sorted(right)[:2]}"
