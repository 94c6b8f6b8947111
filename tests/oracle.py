"""DuckDB over the same tables, and an order-insensitive comparison of results."""

import datetime
import glob
import math
import os

import duckdb
import pandas as pd


def run(sf: str, sql: str) -> pd.DataFrame:
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        at = p + "/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return c.execute(sql).df()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    elif hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat() + "T00:00:00"
    return v


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    return sorted(repr(tuple(plain(x) for x in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


def check(got: pd.DataFrame, sf: str, sql: str) -> None:
    want = run(sf, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
