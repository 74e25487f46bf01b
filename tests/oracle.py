"""Run a query and its SQL on the same tables and compare them as multisets."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def tables(con: duckdb.DuckDBPyConnection, d: str) -> None:
    for p in sorted(Path(d).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE OR REPLACE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x: object) -> str:
        if x is None or (not isinstance(x, (list, tuple, dict)) and pd.isna(x)):
            return "∅"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float):
            return f"{x:.9g}" if x != int(x) else str(int(x))
        return str(x)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty if equal, else what differs."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if len(a) != len(b):
        only = set(a) - set(b), set(b) - set(a)
        return f"rows {len(a)} / {len(b)}; only Spark {sorted(only[0])[:2]}; only SQL {sorted(only[1])[:2]}"
    diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"first difference {diff}" if diff else ""
