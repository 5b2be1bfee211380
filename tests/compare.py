"""Compare a query's rows with DuckDB's."""

import os

import duckdb
import numpy as np
import pandas as pd


def tables(folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = os.path.join(folder, t)
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, list | np.ndarray):
        return str([plain(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "None"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, int | float | np.number):
        return f"{float(x):.9g}"
    return str(x)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
