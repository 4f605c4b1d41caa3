"""Monthly quota of calls with refunds: a call is taken if the quota has room for it, else it is denied and uses nothing.

A charge is an amount of 1, a refund of -1. With s the running sum of amounts, what has been denied so
far is the greatest excess of s over the quota, r, and what is used is s - r: the walk is pushed back at
the quota, one call at a time. So a month's state is two numbers, the batch form is two running windows
over a user's month, and a stream works on whole arrays of calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.state import keep_in_rocksdb

CALL_SCHEMA = "user_id long, month string, event_id long, allowed boolean, used long, remaining long"


def month_of(ts: Column) -> Column:
    return F.date_format(F.col("ts") if isinstance(ts, str) else ts, "yyyy-MM")


def charged(usage: DataFrame, quota: int) -> DataFrame:
    """usage(user_id, ts, event_id, amount) with month, allowed, used and remaining after each, in order of time and event_id."""
    own = W.partitionBy("user_id", "month").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    df = usage.withColumn("month", month_of("ts")).withColumn("_s", F.sum("amount").over(own))
    df = df.withColumn("_r", F.greatest(F.lit(0), F.max(F.col("_s") - quota).over(own)))
    before = F.coalesce(F.lag("_r").over(W.partitionBy("user_id", "month").orderBy("ts", "event_id")), F.lit(0))
    df = df.withColumn("allowed", F.col("_r") == before).withColumn("used", F.col("_s") - F.col("_r"))
    return df.withColumn("remaining", quota - F.col("used")).drop("_s", "_r")


class Quota(StatefulProcessor):
    """Keeps the sum of a user's amounts in a month and how many calls were denied."""

    def __init__(self, quota: int, grace_ms: int):
        self.quota, self.grace_ms = quota, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.month = handle.getValueState("month", "s long, r long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat([r[["ts", "event_id", "amount"]] for r in rows]).sort_values(["ts", "event_id"])
        s, r = self.month.get() if self.month.exists() else (0, 0)
        sums = s + np.cumsum(calls["amount"].to_numpy(np.int64))
        denied = np.maximum.accumulate(np.maximum(r, sums - self.quota))
        self.month.update((int(sums[-1]), int(denied[-1])))
        if not list(self.handle.listTimers()):
            end = (pd.Period(key[1], "M") + 1).to_timestamp()
            self.handle.registerTimer(max(int(end.value // 1_000_000) + self.grace_ms, timerValues.getCurrentWatermarkInMs() + 1))
        used = sums - denied
        yield pd.DataFrame({"user_id": key[0], "month": key[1], "event_id": calls["event_id"].to_numpy(), "allowed": denied == np.concatenate([[r], denied[:-1]]), "used": used, "remaining": self.quota - used})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.month.clear()
        return iter([])

    def close(self) -> None:
        pass


def charged_stream(usage: DataFrame, quota: int, late: str = "1 hour", grace_ms: int = 0) -> DataFrame:
    """The same for a stream of usage(user_id long, ts timestamp, event_id, amount): batches follow each other in time, and a month's state goes after its end."""
    keep_in_rocksdb(usage.sparkSession)
    calls = usage.select("user_id", "ts", "event_id", "amount").withWatermark("ts", late).withColumn("month", month_of("ts"))
    return calls.groupBy("user_id", "month").transformWithStateInPandas(statefulProcessor=Quota(quota, grace_ms), outputStructType=CALL_SCHEMA, outputMode="Append", timeMode="EventTime")
