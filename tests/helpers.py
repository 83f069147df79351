"""Comparison of a query with its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows in order, columns by name, doubles rounded."""
    cell = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 6) + 0.0 if isinstance(x, float) else x
    rows = [tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
