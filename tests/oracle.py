"""Compares a query with its SQL on DuckDB: the same rows, whatever their order."""

import math
import os
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


def difference(con, df, sql):
    """None, or the first rows that only one side has."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if mine == theirs:
        return None
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    a, b = set(mine[1]), set(theirs[1])
    return f"{len(mine[1])} and {len(theirs[1])} rows; only ours {sorted(a - b)[:3]}, only SQL's {sorted(b - a)[:3]}"
