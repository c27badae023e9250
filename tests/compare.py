"""Compare a query's rows with its DuckDB counterpart's."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) if value != int(value) else int(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    return list(found.columns), found.fetchall()


def difference(spark, query, sql: str, sf_dir: str) -> str | None:
    """None if the rows are the same, else what differs first."""
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    columns, theirs = oracle(sql, sf_dir)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = rows_of(df.columns, ours), rows_of(columns, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; e.g. {list(set(map(repr, a)) ^ set(map(repr, b)))[:2]}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{x} against {y}"
    return None
