"""Counts per event-time window, kept by a stream whose rows may come late.

The stream reads landed documents as they come. Spark keeps the counts of the windows that the
watermark has not passed in its state store; a late row within the delay is added to its window, one
beyond it is left out. Every micro-batch writes the windows it changed, in a folder of its own that
a replay overwrites, and the newest count of a window is the one that counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statelog.functions.clock import event_time
from statelog.operators.reads import GROUPINGS, check_stats
from statelog.sources.payload import decode_states, read_landed_stream

WINDOWS = {"hour": "1 hour", "day": "1 day"}
COUNT_SCHEMA = "bucket_start timestamp, group string, count bigint, batch bigint"


def window_counts(
    rows: DataFrame, interval: str = "hour", delay: str = "2 days", group_by: str | None = None
) -> DataFrame:
    """``bucket_start, group, count`` of streaming or still rows with ``event_time``.

    Windows are UTC hours or days, whatever the session's zone: both start at whole hours of the
    epoch. Rows without an event time are in no window.
    """
    check_stats(interval, group_by)
    group = F.lit(None).cast("string") if group_by is None else F.col(group_by)
    counted = (
        rows.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", WINDOWS[interval]), group.alias("group"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.select(F.col("window.start").alias("bucket_start"), "group", "count")


def start_window_counts(
    spark: SparkSession,
    landing: str,
    counts: str,
    checkpoint: str,
    interval: str = "hour",
    delay: str = "2 days",
    group_by: str | None = None,
    files_per_trigger: int | None = None,
    trigger: str | None = None,
) -> StreamingQuery:
    """Start counting the records of landed documents; without a ``trigger`` interval the query takes
    what has landed and ends."""
    records = decode_states(read_landed_stream(spark, landing, files_per_trigger))
    grouped = [name for name in GROUPINGS if name == group_by]
    rows = records.select(
        event_time(F.col("time_position"), F.col("last_contact")).alias("event_time"), *grouped
    )

    def keep(changed: DataFrame, number: int) -> None:
        changed.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(
            f"{counts}/batch-{number}"
        )

    return (
        window_counts(rows, interval, delay, group_by)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"availableNow": True} if trigger is None else {"processingTime": trigger}))
        .start()
    )


def read_window_counts(spark: SparkSession, counts: str) -> DataFrame:
    """The newest count of each window and group."""
    written = spark.read.schema(COUNT_SCHEMA).parquet(f"{counts}/batch-*")
    return written.groupBy("bucket_start", "group").agg(F.max_by("count", "batch").alias("count"))
