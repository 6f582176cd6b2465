"""Comparison of a frame with the rows of a SQL oracle."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "NULL"
    if isinstance(v, float):
        v = round(v, 6) + 0.0
        return str(int(v)) if v == int(v) else str(v)
    return str(list(v)) if hasattr(v, "tolist") and hasattr(v, "__len__") else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in r) for r in frame[columns].itertuples(index=False))
