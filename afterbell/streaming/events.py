"""Structured Streaming over event streams: windows, sessions, idempotent batches. These go beyond the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, files: str = "*.parquet", schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and type; events later than ``late`` are dropped once their window has closed."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: bursts with less than ``gap`` between events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what is there and stop; the result as a table in memory (for tests and small summaries)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(600)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"stream {name} did not end")
    return stream.sparkSession.table(name)


def append_new(stream: DataFrame, target: str, key: str, checkpoint: str) -> None:
    """Append each batch's rows whose key isn't in ``target`` yet: a batch that runs again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(target).select(key), key, "left_anti")
        fresh.select(*batch.columns).write.mode("append").parquet(target)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(600)
    if query.isActive:
        query.stop()
        raise TimeoutError("stream did not end")
