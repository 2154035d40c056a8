"""Rows of Spark and of DuckDB as comparable text."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))
