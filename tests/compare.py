"""Run a query and its SQL counterpart over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = ("events", "part", "supplier")


def duck(data_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(data_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def spark_rows(frame: DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return _sorted(tuple(r) for r in frame.select(*columns).collect())


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    described = con.execute(f"describe {sql}").fetchall()
    types = {row[0]: row[1] for row in described}
    columns = sorted(types)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = con.execute(f"select {quoted} from ({sql}) q").fetchall()
    return columns, [types[c] for c in columns], _sorted(rows)


SPARK_TO_DUCK = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def assert_same(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    columns, types, expected = duck_rows(con, sql)
    assert sorted(frame.columns) == columns
    dtypes = dict(frame.dtypes)
    assert [SPARK_TO_DUCK[dtypes[c]] for c in columns] == types
    actual = spark_rows(frame)
    assert len(actual) == len(expected)
    for got, want in zip(actual, expected):
        assert got == want, (got, want)
    return len(actual)


def _sorted(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, _plain(v)) for v in r))


def _plain(value):
    return 0 if value is None or (isinstance(value, float) and math.isnan(value)) else value
