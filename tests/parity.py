"""Compare a query with its SQL twin in DuckDB, as multisets of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def _value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, int):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    if isinstance(x, dict):
        return tuple(sorted((k, _value(v)) for k, v in x.items()))
    return x


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(con, df, sql: str) -> str:
    """'' if equal, else what differs."""
    rel = con.sql(sql)
    want, have = rows_of(rel.columns, rel.fetchall()), rows_of(df.columns, df.collect())
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    if want == have:
        return ""
    only_a, only_b = have - want, want - have
    return f"rows {sum(have.values())} {sum(want.values())}; only spark {list(only_a)[:2]}; only sql {list(only_b)[:2]}"
