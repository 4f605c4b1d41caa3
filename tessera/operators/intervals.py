"""Containment of spans without comparing pairs: sweeps over bins of text positions.

Spans of both sides are events in order of their start. What a sweep knows at a position (how far the
spans begun so far reach, or which of them began last) is made of two parts: what the position's own bin
has shown, and what all earlier bins of the text have, one row for each bin. So the work is linear in
the spans, and a text that holds most of them is spread over as many groups as it has bins.

Null keys match nothing. Spans without a start or an end hold nothing and lie in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a bin.
BIN = 4096


def _events(inner: DataFrame, outer: DataFrame, key: str, told: Column) -> DataFrame:
    """(_key, _start, _inner, _row, _told): rows of inner as they are, and what outer tells at its starts, with their bin."""
    rows = inner.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.lit(1).alias("_inner"), F.struct("*").alias("_row"), F.lit(None).cast(outer.select(told).schema[0].dataType).alias("_told"))
    marks = outer.where(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    marks = marks.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.lit(0).alias("_inner"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), told.alias("_told"))
    return rows.unionByName(marks).withColumn("_bin", F.floor(F.col("_start") / BIN))


def _swept(events: DataFrame, best) -> DataFrame:
    """Rows of inner, with _told: the best of what was told at or before their start."""
    here = best(F.col("_told")).over(W.partitionBy("_key", "_bin").orderBy("_start", "_inner", "_told").rowsBetween(W.unboundedPreceding, 0))
    bins = events.where("_told is not null").groupBy("_key", "_bin").agg(F.max("_told").alias("_top"))
    asked = events.select("_key", "_bin").distinct().join(bins, ["_key", "_bin"], "left")
    before = asked.withColumn("_before", best(F.col("_top")).over(W.partitionBy("_key").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))).select(F.col("_key").alias("_k"), F.col("_bin").alias("_b"), "_before")
    found = events.withColumn("_here", here).where("_inner = 1").join(before, (F.col("_key") == F.col("_k")) & (F.col("_bin") == F.col("_b")), "left")
    return found.select("_row", best_of(best, F.col("_here"), F.col("_before")).alias("_told"))


def best_of(best, here: Column, before: Column) -> Column:
    return F.greatest(here, before) if best is F.max else F.coalesce(here, before)


def latest(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def with_covered(inner: DataFrame, outer: DataFrame, key: str = "doc_id") -> DataFrame:
    """inner(key, start, end, ...) with covered: whether a span of outer(key, start, end) holds it wholly."""
    found = _swept(_events(inner, outer, key, F.col("end").cast("long")), F.max)
    return found.select("_row.*", F.coalesce(F.col("_told") >= F.col("_row.end"), F.lit(False)).alias("covered"))


def with_holder(inner: DataFrame, outer: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """inner(key, start, end, ...) with value: that of the span of outer(key, start, end, value) that holds it wholly, else null.

    Spans of outer that share a key don't overlap, so only the last to begin at or before a span can hold it.
    """
    told = F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col(value).alias("v"))
    found = _swept(_events(inner, outer, key, told), latest)
    return found.select("_row.*", F.when(F.col("_told.e") >= F.col("_row.end"), F.col("_told.v")).alias(value))
