"""Micro-batch ingestion of landed polls.

The stream reads poll announcements. Each micro-batch takes the polls announced since the last one,
decodes and deduplicates them poll by poll, judges them in one report, and appends each accepted
poll as a snapshot of its own. A rejected or empty poll ends up in the batch log and does not stop
the stream. Many polls per micro-batch cost one pass, so catching up does not go poll by poll.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statelog.operators.bronze import to_bronze
from statelog.operators.dedupe import first_per_state_key
from statelog.plans.log import StateLog, broadcast_if_few
from statelog.sources.payload import (
    RECORD_ORDER,
    decode_states,
    read_arrivals_stream,
    read_landed,
)

# Feeds number their polls on their own.
POLL = ("source_name", "poll_id")


def batch_name(source_name: Column, poll_id: Column) -> Column:
    """The batch id of a feed's poll; the same on every replay."""
    return F.concat(source_name, F.lit("/poll-"), poll_id.cast("string"))


def polls_to_bronze(documents: DataFrame, arrived: DataFrame) -> DataFrame:
    """Deduplicated bronze rows of the announced polls; ``documents`` are lines with their poll."""
    records = decode_states(documents.join(arrived, list(POLL)))
    first = first_per_state_key(records, RECORD_ORDER, batch=POLL)
    return to_bronze(
        first,
        ingest_time=F.col("ingest_time"),
        ingest_batch_id=batch_name(F.col("source_name"), F.col("poll_id")),
        source_name=F.col("source_name"),
    )


def ingest_polls(
    log: StateLog, landing: str, arrived: DataFrame, stream_batch: str | None = None
) -> DataFrame:
    """Ingest the announced polls into the log; returns their batch-log rows.

    A poll is a pair of source and number. One without a landed document is logged as missing, and a
    later announcement of it is taken.
    """
    # A poll announced twice in one go is one poll.
    announced = arrived.groupBy(*POLL).agg(F.min("ingest_time").alias("ingest_time")).persist()
    try:
        bounds = announced.agg(
            F.count(F.lit(1)).alias("polls"), F.min("poll_id").alias("first"), F.max("poll_id").alias("last")
        ).first()
        if not bounds["polls"]:
            return log.batch_log().limit(0)
        announced_few = broadcast_if_few(announced, bounds["polls"])
        documents = read_landed(log.spark, landing).where(
            F.col("poll_id").between(bounds["first"], bounds["last"])
        )
        # Folder names answer this; no line is decoded for it.
        landed = documents.join(announced_few, list(POLL), "left_semi").select(*POLL).distinct()
        batches = announced.join(landed.withColumn("landed", F.lit(True)), list(POLL), "left").select(
            batch_name(*(F.col(name) for name in POLL)).alias("batch_id"),
            "source_name",
            "ingest_time",
            F.coalesce("landed", F.lit(False)).alias("landed"),
        )
        return log.ingest(
            polls_to_bronze(documents, announced_few),
            batches,
            deduplicated=True,
            stream_batch=stream_batch,
        )
    finally:
        announced.unpersist()


def start_ingest_stream(
    spark: SparkSession,
    arrivals: str,
    landing: str,
    log: StateLog,
    checkpoint: str,
    polls_per_trigger: int | None = None,
    interval: str | None = None,
    name: str = "polls",
) -> StreamingQuery:
    """Start ingesting announced polls into the log.

    Without an ``interval`` the query takes what has arrived and ends; with one, such as
    ``"60 seconds"``, it goes on until stopped. A replayed micro-batch changes nothing.
    """

    def take(arrived: DataFrame, number: int) -> None:
        ingest_polls(log, landing, arrived, stream_batch=f"{name}/{number}")

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        read_arrivals_stream(spark, arrivals, polls_per_trigger)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .trigger(**trigger)
        .start()
    )
