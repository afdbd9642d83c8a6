"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(table: pa.Table) -> list[tuple]:
    columns = sorted(table.column_names)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in columns), strict=True)), key=repr)


def assert_same(spark_table: pa.Table, sql_table: pa.Table) -> None:
    assert sorted(spark_table.column_names) == sorted(sql_table.column_names)
    assert rows(spark_table) == rows(sql_table)
