"""Runs a query and its SQL twin on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if os.path.exists(path.replace("/*.parquet", "")):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql: str, folder: str) -> str | None:
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(folder).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} and {len(want)} rows; only here {sorted(g - w)[:3]}; only in SQL {sorted(w - g)[:3]}"
    return None
