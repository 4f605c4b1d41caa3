"""Row-wise operators on streams, and event-time rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.lexicon import RULES, spans


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """files: how many a micro-batch reads; without it one reads all that there are.

    With a watermark, rows older than it in later micro-batches are late and dropped, so files is
    for folders whose files follow each other in event time.
    """
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def scan_stream(docs: DataFrame, rules=RULES) -> DataFrame:
    """Lexicon hits of a stream of documents; no state."""
    return spans(docs, rules)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums by hour and event type; an hour is final once the watermark passes it."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now, then stop; the ended query, which tells its progress."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
