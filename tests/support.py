"""Comparison of a query with its SQL, and small helpers."""

from __future__ import annotations

import glob
import numbers
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return repr(round(float(v), 6)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def same_types(con, df, sql: str) -> None:
    types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    assert {c: DUCK_TYPES.get(t, t.upper()) for c, t in df.dtypes} == types


def as_set(df) -> set[tuple]:
    return {tuple(r) for r in df.collect()}
