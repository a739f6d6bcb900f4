"""Comparison of a query with its oracle SQL, run by DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    plain = lambda x: list(x) if hasattr(x, "__len__") and not isinstance(x, str) else int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted((tuple(map(plain, row)) for row in frame.itertuples(index=False)), key=repr)


def assert_same(query, sql: str, spark, sf_dir: str) -> None:
    found, wanted = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)
