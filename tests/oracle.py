"""Comparison of a query with its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with a view for each table."""
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame) -> list[tuple[str, ...]]:
    """The rows of a data frame as sorted texts, columns by name."""
    text = lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def assert_equal(spark, folder: str, query, sql: str) -> None:
    """Same columns and rows, and some of them."""
    got, want = query(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
