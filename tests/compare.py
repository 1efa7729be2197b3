"""Run a query and its SQL over the same tables and compare all values."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb


def views(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(columns: list[str], found: list, wanted: list[str]) -> list[tuple]:
    places = [columns.index(c) for c in wanted]
    made = [tuple(plain(r[i]) for i in places) for r in found]
    return sorted(made, key=lambda r: tuple((v is None, str(v)) for v in r))


def both(spark, sf: str, query, sql: str) -> tuple[list[tuple], list[tuple]]:
    df = query(spark, sf)
    names = sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()], names)
    relation = views(sf).sql(sql)
    assert sorted(relation.columns) == names
    return got, rows(relation.columns, relation.fetchall(), names)
