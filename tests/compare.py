"""Compare a Spark result with DuckDB's on the same tables, rows in any order."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM '{sf}/{p}'")
    return con


def cell(v):
    if v is None or v is pd.NA or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.9g}"
    if isinstance(v, (bool, np.bool_, int, np.integer)):
        return f"{float(v):.9g}" if abs(int(v)) < 1 << 50 else str(int(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))
