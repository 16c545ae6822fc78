"""Compare registered queries with their SQL in DuckDB, as the driver does."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    own = rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    other = rows(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(own) == len(other), (len(own), len(other))
    for a, b in zip(own, other, strict=True):
        assert a == b, f"{a}\n{b}"
