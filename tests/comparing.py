"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def sql_rows(connection, sql: str) -> tuple[dict[str, str], Counter]:
    result = connection.execute(sql)
    types = {column[0]: str(column[1]) for column in result.description}
    names = list(types)
    order = sorted(range(len(names)), key=names.__getitem__)
    return types, Counter(tuple(row[i] for i in order) for row in result.fetchall())


def spark_rows(frame) -> tuple[dict[str, str], Counter]:
    types = {name: TYPES.get(kind, kind) for name, kind in frame.dtypes}
    return types, Counter(tuple(row) for row in frame.select(*sorted(frame.columns)).collect())


def difference(frame, connection, sql: str) -> str | None:
    """None when rows, names and types agree, else what differs."""
    expected_types, expected = sql_rows(connection, sql)
    types, actual = spark_rows(frame)
    if types != expected_types:
        return f"types: {types} is not {expected_types}"
    if actual != expected:
        only, missing = actual - expected, expected - actual
        return (
            f"rows {actual.total()} / {expected.total()}; only in Spark {only.total()}: {list(only)[:3]}; "
            f"only in SQL {missing.total()}: {list(missing)[:3]}"
        )
    return None
