"""Runs a registered query on Spark and its SQL on DuckDB, and compares the rows as a multiset."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value) -> str:
    return {"bool": "bool", "int": "int", "float": "float", "Decimal": "decimal", "str": "str"}.get(type(value).__name__, type(value).__name__)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kinds_of(names, rows):
    found = {n: set() for n in names}
    for r in rows:
        for n, value in zip(names, r):
            if value is not None:
                found[n].add(kind(value))
    return found


def difference(spark, connection, query, sql: str, folder: str) -> str | None:
    """None when both agree, else a short description."""
    df = query(spark, folder)
    ours_raw = [tuple(r) for r in df.collect()]
    cursor = connection.execute(sql)
    their_names = [d[0] for d in cursor.description]
    theirs_raw = cursor.fetchall()
    names, ours = rows_of(df.columns, ours_raw)
    other_names, theirs = rows_of(their_names, theirs_raw)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if len(ours) != len(theirs):
        missing = [r for r in theirs if r not in set(ours)][:2]
        extra = [r for r in ours if r not in set(theirs)][:2]
        return f"{len(ours)} rows against {len(theirs)}; extra {extra}; missing {missing}"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}"
    mine, other = kinds_of(df.columns, ours_raw), kinds_of(their_names, theirs_raw)
    if mine != other:
        return f"types {[(n, mine[n], other[n]) for n in mine if mine[n] != other[n]]}"
    return None
