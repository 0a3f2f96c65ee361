"""Comparing a Spark result with DuckDB's."""

from __future__ import annotations

import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return con


def cell(v):
    return ("nan" if v != v else round(v, 6)) if isinstance(v, float) else v


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    places = [found.columns.index(c) for c in columns]
    ours = sorted((tuple(cell(row[c]) for c in columns) for row in df.collect()), key=repr)
    theirs = sorted((tuple(cell(row[k]) for k in places) for row in found.fetchall()), key=repr)
    assert ours == theirs
