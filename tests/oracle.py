"""Run a registered query in Spark and its SQL in DuckDB, and compare all values."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan") if math.isnan(v) else (2, repr(v + 0.0))
    if isinstance(v, int):
        return (2, repr(float(v))) if abs(v) < 2**53 else (3, str(v))
    return (4, str(v))


def table_rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_value(v) for v in row) for row in zip(*cols))


def same_numbers(a, b) -> bool:
    """Quick and strict: equal column names, and equal rows in sorted order, for large tables of numbers, texts and truth values without nulls."""
    names = sorted(a.column_names)
    if a.num_rows < 50_000 or names != sorted(b.column_names) or a.num_rows != b.num_rows or any(t.column(n).null_count for t in (a, b) for n in names):
        return False
    sides = []
    for t in (a, b):
        cols = [t.column(n).to_numpy() for n in names]
        cols = [c.astype(str) if c.dtype == object else c + 0 if c.dtype.kind == "f" else c.astype(np.int64) for c in cols]
        order = np.lexsort(cols[::-1])
        sides.append([c[order] for c in cols])
    return all(x.dtype.kind == y.dtype.kind and np.array_equal(x, y) for x, y in zip(*sides))


def compare(spark, con, fn, sql, sf_dir) -> str | None:
    """None when equal, otherwise what differs."""
    got_table, want_table = fn(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table()
    if same_numbers(got_table, want_table):
        return None
    got_names, got = table_rows(got_table)
    want_names, want = table_rows(want_table)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference: {a} != {b}"
    return None
