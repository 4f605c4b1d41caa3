"""Rows of a query against those of its SQL in DuckDB, in any order."""

import datetime
import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows_of_sql(sql: str, sf_dir: str, columns: list) -> list:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    return sorted(repr([plain(r[i]) for i in place]) for r in found.fetchall())


def rows_of_frame(df, columns: list) -> list:
    return sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())


def check(query, sql: str, spark, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    assert rows_of_frame(df, columns) == rows_of_sql(sql, sf_dir, columns)
