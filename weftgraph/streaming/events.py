"""Structured Streaming forms over the events table (§2.11): windowed counts with
late data, idempotent ingestion, stabilisation of versions, maintenance by count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums per window and type, final once the watermark has passed.
    Works on a stream and on a table alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows per user."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def dedupe(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def ingest_once(stream: DataFrame, key: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Append only rows whose key the target does not hold; a batch that runs
    twice adds nothing."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = transform(batch).dropDuplicates([key])
        try:
            have = spark.read.parquet(target).select(key)
            new = new.join(have, key, "left_anti")
        except Exception as e:  # no target yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stable_since(versions: DataFrame, unchanged: int = 3) -> DataFrame:
    """Per category the first version after which the label count stayed equal
    for ``unchanged`` versions. ``versions``: category, version, labels."""
    w = Window.partitionBy("category").orderBy("version")
    changed = F.when(F.col("labels") == F.lag("labels").over(w), 0).otherwise(1)
    run = versions.withColumn("grp", F.sum(changed).over(w))
    n = F.row_number().over(Window.partitionBy("category", "grp").orderBy("version"))
    return run.withColumn("n", n).filter(F.col("n") == unchanged + 1).groupBy("category").agg(F.min("version").alias("stable_at"))


def maintenance_points(events: DataFrame, every: int = 600) -> DataFrame:
    """The batch number of each event when work is due every so many events: counted
    per day first, so no task orders them all."""
    d = events.withColumn("day", F.to_date("ts"))
    per = d.groupBy("day").agg(F.count("*").alias("c"))
    before = per.select("day", (F.sum("c").over(Window.orderBy("day")) - F.col("c")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))
    return d.join(before, "day").select("event_id", F.floor((F.col("before") + nth - 1) / every).alias("batch"))
