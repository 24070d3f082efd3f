"""Run a query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_cell, v))
    return str(v) if hasattr(v, "isoformat") or type(v).__name__ == "Decimal" else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, connection, sf_dir: str, query, sql: str) -> str:
    """Empty if the rows are the same."""
    df = query(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    want = _rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    off = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(off)} of {len(got)} rows, as {off[:2]}" if off else ""
