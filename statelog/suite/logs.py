"""Logs built from the test view, once per session and data folder, for the queries that read them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.plans.log import StateLog
from statelog.plans.scratch import new_folder
from statelog.schema import BRONZE_COLUMNS
from statelog.streaming.ingest import start_ingest_stream
from statelog.streaming.windows import read_window_counts, start_window_counts
from statelog.suite import view

PARTS = 3
EVOLVED_COLUMN = "data_quality_grade"
RETAINED = 10

_BUILT: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, build: Callable):
    """What ``build`` made for this application, made now if it has not been yet."""
    view.use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _BUILT:
        _BUILT[key] = build(spark, sf_dir)
    return _BUILT[key]


def _on(spark: SparkSession, log: StateLog) -> StateLog:
    return StateLog(spark, log.root, log.identifier)


def _announced(rows: DataFrame) -> DataFrame:
    """One announcement per batch of the rows."""
    return rows.select(
        F.col("ingest_batch_id").alias("batch_id"), "source_name", "ingest_time"
    ).distinct()


def _parts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """Rows and announcements of each third of the poll range."""
    rows = view.bronze(spark, sf_dir)
    first, last = rows.agg(F.min("poll_id"), F.max("poll_id")).first()
    third = F.floor((F.col("poll_id") - first) * PARTS / (last - first + 1))
    parts = [rows.where(third == n) for n in range(PARTS)]
    return [(part.select(*BRONZE_COLUMNS), _announced(part)) for part in parts]


def build_batch_log(spark: SparkSession, sf_dir: str) -> StateLog:
    log = StateLog(spark, new_folder(spark, "batch-log"))
    for rows, announced in _parts(spark, sf_dir):
        log.ingest(rows, announced, cache=False)
    return log


def batch_log(spark: SparkSession, sf_dir: str) -> StateLog:
    """Gated batches in three writes, duplicates kept, partitioned by day."""
    return _on(spark, _once(spark, sf_dir, "batch", build_batch_log))


def _build_late_log(spark: SparkSession, sf_dir: str) -> StateLog:
    log = StateLog(spark, new_folder(spark, "late-log"))
    first, late, last = _parts(spark, sf_dir)
    for rows, announced in (first, last, late):
        log.ingest(rows, announced, cache=False)
    return log


def late_log(spark: SparkSession, sf_dir: str) -> StateLog:
    """The same batches, the middle third of them committed after all others."""
    return _on(spark, _once(spark, sf_dir, "late", _build_late_log))


def _build_expired_log(spark: SparkSession, sf_dir: str) -> StateLog:
    log = StateLog(spark, new_folder(spark, "expired-log"))
    rows = view.bronze(spark, sf_dir)
    log.ingest(rows.select(*BRONZE_COLUMNS), _announced(rows), cache=False)
    log.expire_snapshots(retain_last=RETAINED)
    return log


def expired_log(spark: SparkSession, sf_dir: str) -> StateLog:
    """Every poll in one write, and all but the newest snapshots expired."""
    return _on(spark, _once(spark, sf_dir, "expired", _build_expired_log))


def _build_evolved_log(spark: SparkSession, sf_dir: str) -> tuple[StateLog, int]:
    log = StateLog(spark, new_folder(spark, "evolved-log"))
    parts = _parts(spark, sf_dir)
    log.ingest(*parts[0], cache=False)
    before = log.snapshot_id_of()
    log.add_column(EVOLVED_COLUMN, "string")
    rows, announced = parts[1]
    log.ingest(rows.withColumn(EVOLVED_COLUMN, F.lit("B")), announced, cache=False)
    log.repartition_by("hour")
    rows, announced = parts[2]
    log.ingest(rows.withColumn(EVOLVED_COLUMN, F.lit("A")), announced, cache=False)
    return log, before


def evolved_log(spark: SparkSession, sf_dir: str) -> tuple[StateLog, int]:
    """A log that gained a column after its first write and an hourly layout before its third.

    Also the id of the last snapshot before the change.
    """
    log, before = _once(spark, sf_dir, "evolved", _build_evolved_log)
    return _on(spark, log), before


def _streamed(spark: SparkSession, purpose: str, landed: DataFrame, *waves: DataFrame) -> StateLog:
    """What a stream makes of landed documents that are announced in waves, one run for each."""
    folder = new_folder(spark, purpose)
    landing, arrivals = f"{folder}/landing", f"{folder}/arrivals"
    landed.write.partitionBy("source_name", "poll_id").text(landing)
    log = StateLog(spark, f"{folder}/log")
    for wave in waves:
        wave.write.mode("append").json(arrivals)
        start_ingest_stream(
            spark, arrivals, landing, log, f"{folder}/checkpoint"
        ).awaitTermination()
    return log


def build_stream_log(spark: SparkSession, sf_dir: str) -> StateLog:
    announced = view.polls(spark, sf_dir)
    first, last = announced.agg(F.min("poll_id"), F.max("poll_id")).first()
    early = F.col("poll_id") <= (first + last) // 2
    # The second run goes on from the first one's checkpoint.
    return _streamed(
        spark, "stream", view.landed(spark, sf_dir), announced.where(early), announced.where(~early)
    )


def stream_log(spark: SparkSession, sf_dir: str) -> StateLog:
    """What the stream made of every landed poll, deduplicated and gated."""
    return _on(spark, _once(spark, sf_dir, "stream", build_stream_log))


def _build_two_feed_log(spark: SparkSession, sf_dir: str) -> StateLog:
    # Days alternate between the feeds; halved, their numbers are the same in both.
    half = F.expr("poll_id div 2")
    return _streamed(
        spark, "two-feeds", view.landed(spark, sf_dir).withColumn("poll_id", half),
        view.polls(spark, sf_dir).withColumn("poll_id", half),
    )


def two_feed_log(spark: SparkSession, sf_dir: str) -> StateLog:
    """Polls of two feeds with the same numbers."""
    return _on(spark, _once(spark, sf_dir, "two-feeds", _build_two_feed_log))


def _build_hourly_log(spark: SparkSession, sf_dir: str) -> StateLog:
    documents = view.hourly(spark, sf_dir)
    announced = documents.select("source_name", "poll_id").distinct().withColumn(
        "ingest_time", F.timestamp_seconds((F.col("poll_id") + 1) * 3600)
    )
    return _streamed(spark, "hourly", documents, announced)


def hourly_log(spark: SparkSession, sf_dir: str) -> StateLog:
    """A poll for every hour that has events, of one feed."""
    return _on(spark, _once(spark, sf_dir, "hourly", _build_hourly_log))


#: A landed hour comes late where this divides its number.
LATE_HOURS = 23
WAVES = 4


def _build_window_counts(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "window-counts")
    documents = view.hourly(spark, sf_dir)
    first, last = documents.agg(F.min("poll_id"), F.max("poll_id")).first()
    wave = F.floor((F.col("poll_id") - first) * WAVES / (last - first + 1))
    # The last hours of a wave that are late come with the next one, after the watermark has moved.
    ends = F.floor((F.col("poll_id") + 30 - first) * WAVES / (last - first + 1))
    late = (F.col("poll_id") % LATE_HOURS == 0) & (ends < WAVES)
    turn = F.when(late, F.greatest(wave, ends)).otherwise(wave)
    for number in range(WAVES):
        documents.where(turn == number).write.mode("append").partitionBy("source_name", "poll_id").text(
            f"{folder}/landing")
        start_window_counts(
            spark, f"{folder}/landing", f"{folder}/counts", f"{folder}/checkpoint", delay="2 days",
            group_by="origin_country",
        ).awaitTermination()
    return f"{folder}/counts"


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by country of a stream to which some hours came a day late."""
    return read_window_counts(spark, _once(spark, sf_dir, "window-counts", _build_window_counts))
