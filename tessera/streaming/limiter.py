"""Sliding-window limiter: calls in the window of each key, denied ones included; calls of one millisecond count once.

In batch form a key's time is cut into slices, SLICES to a window. The number of different milliseconds
before a moment is what all earlier slices hold (a running sum over one row for each slice) plus what
comes before it in its own slice; the calls in a window are the difference of two such numbers, at the
call and a window before it. So only the two slices at the window's edges are looked at row by row, and a
key that has most of the calls is spread over as many groups as its time has slices.

In stream form each key keeps its different milliseconds of the last window as list state in RocksDB,
and a timer that clears it once the watermark is a window past the last of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.state import keep_in_rocksdb

HIT_SCHEMA = "key string, ts timestamp, event_id long, used int, remaining int, allowed boolean, retry_after int"
SLICES = 64


def counts_before(moments: DataFrame, width: int) -> DataFrame:
    """moments(key, at, counted, ...) with before: how many counted rows of the key have an earlier at. width: of a slice."""
    df = moments.withColumn("_slice", F.floor(F.col("at") / width))
    one = F.when(F.col("counted"), 1).otherwise(0)
    inside = F.coalesce(F.sum(one).over(W.partitionBy("key", "_slice").orderBy("at").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = df.groupBy("key", "_slice").agg(F.sum(one).alias("_here"))
    earlier = F.coalesce(F.sum("_here").over(W.partitionBy("key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(F.col("key").alias("_k"), F.col("_slice").alias("_s"), earlier.alias("_earlier"))
    found = df.withColumn("_inside", inside).join(slices, F.col("key").eqNullSafe(F.col("_k")) & F.col("_slice").eqNullSafe(F.col("_s")))
    return found.withColumn("before", F.col("_inside") + F.col("_earlier")).drop("_slice", "_inside", "_k", "_s", "_earlier")


def limited(hits: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """hits(key, ts, event_id) with used, remaining, allowed and retry_after.

    The state before a call is the set of its key's different milliseconds within the window, so
    used is their number among earlier calls (in order of time, then event_id), plus one.
    """
    window = window_seconds * 1000
    seen = hits.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("nth", F.row_number().over(W.partitionBy("key", "ms").orderBy("event_id")))
    calls = seen.where("nth = 1").select("key", F.col("ms").alias("call"))
    now = calls.select("key", "call", F.col("call").alias("at"), F.lit(True).alias("counted"))
    then = calls.select("key", "call", (F.col("call") - window + 1).alias("at"), F.lit(False).alias("counted"))
    known = counts_before(now.unionByName(then), max(1, window // SLICES))
    within = F.max(F.when(F.col("counted"), F.col("before"))) - F.max(F.when(~F.col("counted"), F.col("before")))
    earlier = known.groupBy("key", "call").agg(within.alias("_within")).select(F.col("key").alias("_k"), "call", "_within")
    used = (F.col("_within") + F.when(F.col("nth") > 1, 2).otherwise(1)).cast("int")
    out = seen.join(earlier, F.col("key").eqNullSafe(F.col("_k")) & F.col("ms").eqNullSafe(F.col("call"))).withColumn("used", used).withColumn("allowed", F.col("used") <= limit)
    return out.withColumns({"remaining": F.greatest(F.lit(0), limit - F.col("used")), "retry_after": F.when(F.col("allowed"), 0).otherwise(window_seconds)}).drop("ms", "nth", "_k", "call", "_within")


def used_calls(held: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """For calls at times, in order, the number of different milliseconds in each one's window, the call counted. held: earlier ones."""
    known = np.union1d(held, times)
    inside = np.searchsorted(known, times, "left") - np.searchsorted(known, times - window + 1, "left")
    repeated = np.isin(times, held) | np.concatenate([[False], times[1:] == times[:-1]])[: len(times)]
    return inside + np.where(repeated, 2, 1)


class Limiter(StatefulProcessor):
    """Keeps a key's different milliseconds of the last window."""

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat([r[["ts", "event_id"]] for r in rows]).sort_values(["ts", "event_id"])
        held = np.fromiter((r[0] for r in self.times.get()), np.int64)
        times = calls["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64)
        used = used_calls(held, times, self.window)
        known = np.union1d(held, times)
        kept = known[known > known[-1] - self.window]
        self.times.put([(int(t),) for t in kept])
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(int(kept[-1]) + self.window, timerValues.getCurrentWatermarkInMs() + 1))
        allowed = used <= self.limit
        yield pd.DataFrame({"key": key[0], "ts": calls["ts"].to_numpy(), "event_id": calls["event_id"].to_numpy(), "used": used.astype(np.int32), "remaining": np.maximum(0, self.limit - used).astype(np.int32), "allowed": allowed, "retry_after": np.where(allowed, 0, self.window // 1000).astype(np.int32)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited_stream(hits: DataFrame, limit: int, window_seconds: int, late: str = "1 hour") -> DataFrame:
    """The same for a stream of hits (ts a timestamp), in order of time within a batch; a key's state goes once the watermark is a window past its last call."""
    keep_in_rocksdb(hits.sparkSession)
    calls = hits.select("key", "ts", "event_id").withWatermark("ts", late)
    return calls.groupBy("key").transformWithStateInPandas(statefulProcessor=Limiter(limit, window_seconds), outputStructType=HIT_SCHEMA, outputMode="Append", timeMode="EventTime")
