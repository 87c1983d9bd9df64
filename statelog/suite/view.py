"""State vectors derived from the ``events`` test table, with faults on purpose.

One day of events is one poll. Polls whose number ends in 3 have NULLs in required fields and those
ending in 7 have impossible coordinates, so the gate rejects them; WARN faults occur in every poll.
The contact time is the end of a ten-minute slot, so one aircraft repeats a state key now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.operators.bronze import to_bronze
from statelog.sources.payload import POSITIONS
from statelog.streaming.ingest import batch_name

SLOT_SECONDS = 600
DAY_SECONDS = 86400

# States per landed document; event ids are unique, so no document holds more.
STATES_PER_DOCUMENT = 64

_RECORD = {
    "icao24": "case when poll_id % 10 = 3 and event_id % 11 = 0 then null "
    "else lpad(lower(hex(user_id)), 6, '0') end",
    "callsign": "case when event_id % 13 = 0 then '   ' "
    "when event_id % 101 = 0 then ' LONGCALLSIGN ' "
    "else concat(upper(substr(event_type, 1, 3)), cast(user_id as string), '  ') end",
    "origin_country": "case when event_id % 29 = 0 then null else event_type end",
    "time_position": "case when event_id % 7 = 0 then null else epoch end",
    "last_contact": "case when poll_id % 10 = 3 and event_id % 11 = 1 then null "
    f"else (epoch div {SLOT_SECONDS} + 1) * {SLOT_SECONDS} end",
    "longitude": "case when event_id % 17 = 0 then null "
    "when poll_id % 10 = 7 and event_id % 11 = 1 then -999.0D "
    "else cast((event_id * 104729) % 36000 as double) / 100.0D - 180.0D end",
    "latitude": "case when event_id % 17 = 0 then null "
    "when poll_id % 10 = 7 and event_id % 11 = 0 then 999.0D "
    "else cast((event_id * 7919) % 18000 as double) / 100.0D - 90.0D end",
    "baro_altitude": "value * 20.0D",
    "geo_altitude": "case when event_id % 19 = 0 then null when event_id % 103 = 0 then 90000.0D "
    "else value * 20.0D + 50.0D end",
    "on_ground": "case when poll_id % 10 = 3 and event_id % 11 = 2 then null "
    "else event_id % 3 = 0 end",
    "velocity": "value * 6.0D",
    "true_track": "cast((event_id * 37) % 360 as double)",
    "vertical_rate": "value / 10.0D - 20.0D",
    "squawk": "case when event_id % 5 = 0 then null "
    "else lpad(cast(event_id % 8000 as string), 4, '0') end",
    "spi": "event_id % 50 = 0",
    "position_source": "cast(case when event_id % 23 = 0 then null when event_id % 41 = 0 then 9 "
    "else event_id % 4 end as int)",
    "category": "cast(case when event_id % 31 = 0 then null else event_id % 20 end as int)",
}


def use_utc(spark: SparkSession) -> None:
    """The test tables hold zone-less timestamps that mean UTC, as the SQL side reads them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with their poll and its provenance, ``event_id`` being their order."""
    use_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    return (
        events.withColumn("epoch", epoch)
        .withColumn("poll_id", F.expr(f"epoch div {DAY_SECONDS}"))
        .select(
            "event_id",
            "poll_id",
            *provenance("poll_id"),
            *[F.expr(text).alias(name) for name, text in _RECORD.items()],
        )
    )


def provenance(poll_id: str):
    """Source and ingest time of a poll: two feeds in turn, landed five seconds past the day."""
    source = F.when(F.col(poll_id) % 2 == 0, "feed_a").otherwise("feed_b")
    landed = F.timestamp_seconds((F.col(poll_id) + 1) * DAY_SECONDS + 5)
    return source.alias("source_name"), landed.alias("ingest_time")


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows of every poll, neither deduplicated nor gated, with ``event_id, poll_id``."""
    return to_bronze(
        records(spark, sf_dir),
        ingest_time=F.col("ingest_time"),
        ingest_batch_id=batch_name(F.col("source_name"), F.col("poll_id")),
        source_name=F.col("source_name"),
        keep=("event_id", "poll_id"),
    )


def _json_value(name: str, type_name: str | None):
    """A position as JSON text. The strings of the test table need no escapes."""
    if type_name is None:
        return F.lit("[1, 2]")
    text = F.col(name).cast("string")
    if type_name == "string":
        text = F.concat(F.lit('"'), text, F.lit('"'))
    return F.coalesce(text, F.lit("null"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed documents of every poll: ``poll_id, value``, a bounded number of states in each."""
    return _documents(records(spark, sf_dir))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed documents of one feed whose polls are the hours: ``source_name, poll_id, value``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.expr("unix_seconds(cast(ts as timestamp)) div 3600")
    hours = events.select("event_id", hour.alias("hour"))
    raw = records(spark, sf_dir).join(hours, "event_id").withColumn("poll_id", F.col("hour"))
    return _documents(raw).select(F.lit("feed_h").alias("source_name"), "poll_id", "value")


def _documents(raw: DataFrame) -> DataFrame:
    """An array whose category is NULL is one item short, as sources send it."""
    values = [_json_value(name, type_name) for name, type_name in POSITIONS]
    full = F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))
    short = F.concat(F.lit("["), F.concat_ws(",", *values[:-1]), F.lit("]"))
    state = F.when(F.col("category").isNull(), short).otherwise(full)
    seq = F.floor(F.col("event_id") / STATES_PER_DOCUMENT)
    grouped = raw.groupBy("poll_id", seq.alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", state.alias("state")))).alias("items")
    )
    states = F.array_join(F.transform("items", lambda item: item["state"]), ",")
    value = F.format_string(
        '{"time": %d, "seq": %d, "states": [%s]}',
        (F.col("poll_id") + 1) * DAY_SECONDS,
        F.col("seq"),
        states,
    )
    return grouped.select("poll_id", value.alias("value"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of every poll, and of an empty one after the last."""
    full = records(spark, sf_dir).select("poll_id").distinct()
    return full.unionByName(_empty(full)).select("poll_id", *provenance("poll_id"))


def _empty(full: DataFrame) -> DataFrame:
    return full.agg((F.max("poll_id") + 1).alias("poll_id"))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every poll as they are landed, the empty one's without states."""
    full = documents(spark, sf_dir)
    empty = _empty(full.select("poll_id")).withColumn("value", F.lit('{"states": null}'))
    source, _ = provenance("poll_id")
    return full.unionByName(empty).select(source, "poll_id", "value")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every event: ``event_id, moment``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("moment"))
