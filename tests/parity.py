"""Results of a query held against those of its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


#: Digits that no decimal of either engine exceeds.
EXACT = decimal.Context(prec=80)


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4; SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(v):
    """A value as both engines may give it."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return v.normalize(EXACT)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """The number of rows; AssertionError where columns or rows differ."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    assert len(mine) == len(theirs), f"{len(mine)} rows, {len(theirs)} by SQL"
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, f"{a} is {b} by SQL"
    return len(mine)
