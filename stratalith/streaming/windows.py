"""Streaming counts over event time (an extension: the batch operators need no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, value) by tumbling windows with a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def to_files(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream over what is available and gives the newest row of each key.

    Every batch writes the rows it changed as files of their own under its number, so a repeated batch replaces itself
    and nothing is held on the driver.
    """
    names = stream.columns

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(path)
    newest = F.max_by(F.struct(*(c for c in names if c not in keys)), "batch").alias("x")
    return rows.groupBy(*keys).agg(newest).select(*keys, "x.*").select(*names)
