"""Side-by-side comparison of the Spark queries with the SQL answers."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def table(names, tuples):
    """Columns by name and rows in a canonical order."""
    order = sorted(range(len(names)), key=lambda place: names[place])
    rows = [tuple(_plain(row[place]) for place in order) for row in tuples]
    return [names[place] for place in order], sorted(rows, key=lambda row: tuple(map(repr, row)))


def spark_table(df):
    return table(df.columns, [tuple(row) for row in df.collect()])


def oracle_table(connection, sql):
    result = connection.execute(sql)
    return table([column[0] for column in result.description], result.fetchall())
