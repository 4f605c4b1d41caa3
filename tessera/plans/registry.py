"""Where queries are registered: a name, a callable of (spark, sf_dir), and SQL for the same rows."""

from __future__ import annotations

from tessera.sources.tables import shared_dir  # noqa: F401 - queries take it from here

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
