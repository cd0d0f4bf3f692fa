"""Run registered queries and their SQL side by side."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(frame.columns)
    for column in columns:
        if pd.api.types.is_datetime64_any_dtype(frame[column]):
            frame = frame.assign(**{column: frame[column].astype("datetime64[us]")})
        elif isinstance(frame[column].dtype, pd.Int64Dtype):  # whole numbers with nulls
            frame = frame.assign(**{column: frame[column].astype("float64" if frame[column].hasnans else "int64")})
    return frame[columns].sort_values(columns, na_position="last").reset_index(drop=True)


def difference(spark_result: pd.DataFrame, sql_result: pd.DataFrame) -> str | None:
    """None if both hold the same rows, whatever their order; values must be identical."""
    left, right = _sorted(spark_result), _sorted(sql_result)
    if list(left.columns) != list(right.columns):
        return f"columns {list(left.columns)} and {list(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    if list(left.dtypes) != list(right.dtypes):
        return f"types {list(left.dtypes)} and {list(right.dtypes)}"
    for column in left.columns:
        a, b = left[column], right[column]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = int((~same).idxmax())
            return f"{int((~same).sum())} values of {column}, first {a[at]!r} and {b[at]!r}"
    return None
