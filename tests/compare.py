"""A Spark result against DuckDB on the same files, row by row, order aside."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(v: object) -> object:
    v = v.tolist() if hasattr(v, "tolist") else v
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(float(v)) else float(v)
    return str(v)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    asked = con.execute(sql)
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    at = [names.index(c) for c in order]
    wanted = sorted((tuple(plain(r[i]) for i in at) for r in asked.fetchall()), key=str)
    assert rows == wanted
