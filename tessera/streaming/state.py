"""Where streams keep their state, and what they report of it."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_in_rocksdb(spark: SparkSession) -> None:
    """State of queries that start from now on lies in RocksDB, which keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state that each micro-batch reported, in order."""
    return [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]
