"""Run a Spark query and its DuckDB oracle on the same tables and compare
row count, column names and order-insensitive values (the driver's gate)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from panelforge.sources.tables import TABLES


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, oracle_df: pd.DataFrame) -> list[str]:
    s = spark_df.toPandas()
    problems = []
    if sorted(s.columns) != sorted(oracle_df.columns):
        problems.append(f"columns differ: spark-only {sorted(set(s.columns) - set(oracle_df.columns))} "
                        f"oracle-only {sorted(set(oracle_df.columns) - set(s.columns))}")
        return problems
    if len(s) != len(oracle_df):
        problems.append(f"row count {len(s)} vs {len(oracle_df)}")
    a, b = canon(s), canon(oracle_df)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ, first: {diffs}")
    return problems
