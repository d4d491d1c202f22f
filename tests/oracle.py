"""Compare a Spark result with the DuckDB result of its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return x


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def _kind(arrow_type) -> str:
    return str(arrow_type).replace("large_", "")


def difference(con, sql: str, df) -> str | None:
    """None when both results hold the same columns, types and rows."""
    spark = df.toArrow()
    other = con.sql(sql).to_arrow_table()
    mine = {f.name: _kind(f.type) for f in spark.schema}
    theirs = {f.name: _kind(f.type) for f in other.schema}
    if mine != theirs:
        return f"columns differ: {mine} / {theirs}"
    a = _rows(spark.column_names, zip(*[c.to_pylist() for c in spark.columns]))
    b = _rows(other.column_names, zip(*[c.to_pylist() for c in other.columns]))
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {str(bad[0][0])[:300]} / {str(bad[0][1])[:300]}"
    return None
