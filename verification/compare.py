"""Run named queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path
from typing import Any

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, statement: str) -> str | None:
    """What differs, or ``None`` when names, types, row count and values agree."""
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    kinds = {n: str(d[1]) for n, d in zip(names, result.description)}
    for name, dtype in df.dtypes:
        if _kind(dtype) != _kind(kinds[name].lower()):
            return f"type of {name}: {dtype} against {kinds[name]}"
    for a, b in zip(ours, theirs):
        if a != b:
            columns = sorted(names)
            cells = [(c, x, y) for c, x, y in zip(columns, a, b) if x != y]
            return f"first difference {cells} in {a}"
    return None


def _kind(dtype: str) -> str:
    same = {
        "varchar": "string", "integer": "int", "timestamp_ntz": "timestamp",
        "string": "string", "number": "number",
    }
    return same.get(dtype, dtype)
