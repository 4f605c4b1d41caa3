"""One stream into several tables, each micro-batch once: batches are folders by their number, and count when a marker says so.

A batch that is run again after a failure replaces what it had written, and readers see only batches
whose marker is there, so no row is seen twice or without its companions in the other tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.writers import sign_up
from tessera.sources.tables import read_if_there

COMMITTED = "batch long, at timestamp"


def committed(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Numbers of the batches that count."""
    marks = read_if_there(spark, f"{path}/_committed", COMMITTED)
    return sorted(r["batch"] for r in (marks if before is None else marks.where(F.col("batch") < before)).select("batch").distinct().collect())


def read(spark: SparkSession, path: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of a table in the batches that count."""
    batches = committed(spark, path, before)
    rows = read_if_there(spark, f"{path}/{name}", f"{schema}, batch long")
    return rows.where(F.col("batch").isin(batches)).drop("batch") if batches else rows.limit(0).drop("batch")


def write_batch(tables: dict, path: str, number: int) -> None:
    """Write each table's rows of a batch in place of any that it had, then the marker."""
    for name, rows in tables.items():
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    mark = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(number).cast("long").alias("batch"))
    mark.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/_committed")


def fan_out(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame, int], dict]) -> StreamingQuery:
    """Start writing make(rows of a micro-batch, its number), a dict of tables, under path; ends with what is there now."""

    def one(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            write_batch(make(rows, number), path, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SIGN_UP = {
    "profiles": "user_id long, display_name string, active_project string, created_at timestamp",
    "projects": "project_id string, name string, is_default boolean, created_at timestamp",
    "members": "project_id string, user_id long, role string, joined_at timestamp",
}


def sign_ups(users: DataFrame, path: str, checkpoint: str, at: str) -> StreamingQuery:
    """A stream of new users(user_id, email, display_name) into profiles, projects and members; a user who has signed up before brings nothing."""
    spark = users.sparkSession

    def make(rows: DataFrame, number: int) -> dict:
        known = read(spark, path, "profiles", SIGN_UP["profiles"], number).select("user_id")
        return sign_up(rows.where("user_id is not null").dropDuplicates(["user_id"]).join(known, "user_id", "left_anti"), at)

    return fan_out(users, path, checkpoint, make)
