"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_duckdb(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, Decimal)):
        number = float(value)
        if math.isnan(number):
            return "NaN"
        return int(number) if number.is_integer() else number
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(cell(row[i]) for i in order) for row in rows), key=lambda t: tuple(str(x) for x in t))


def compare(spark, con, name, query, sql, folder):
    """Problem text, or None when both sides agree exactly."""
    frame = query(spark, folder)
    got_names, got = table(frame.columns, [tuple(x) for x in frame.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want_names, want = table(columns, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    if got != want:
        off = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(off)} of {len(got)} rows differ, first {off[0]}"
    if not got:
        return "no rows"
    return None
