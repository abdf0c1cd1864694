"""Streams of events: windows, sessions, first-seen deduplication and joins with tables. An extension of the library's batch scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A folder of parquet files as a stream, or one file as a folder's only match."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return timed(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder))


def timed(events: DataFrame) -> DataFrame:
    """Event time as an instant: watermarks need one; a time without zone is taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    stream = events.withWatermark("ts", late) if events.isStreaming else timed(events)
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    stream = events.withWatermark("ts", late) if events.isStreaming else timed(events)
    return stream.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    stream = events.withWatermark("ts", late) if events.isStreaming else timed(events)
    return stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def with_table(events: DataFrame, table: DataFrame, on: str) -> DataFrame:
    return events.join(table, on)


def run_available(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there and stop; offsets and state are kept in the shared folder next to the result."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stream-{name}"
