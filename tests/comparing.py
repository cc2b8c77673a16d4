"""Compare a query with its SQL, run by another engine over the same tables."""

import glob
import math
import os

import duckdb


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        files = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{files}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(columns: list[str], records) -> list[list[str]]:
    return sorted([_cell(r[c]) for c in columns] for r in records)


def assert_equal(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert columns == sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    got = [r.asDict() for r in df.collect()]
    assert rows(columns, got) == rows(columns, want)
