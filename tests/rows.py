"""Literal state vectors."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from statelog.plans.log import BATCH_SCHEMA
from statelog.schema import BRONZE_COLUMNS, bronze_schema
from pyspark.sql import types as T

T0 = datetime(2026, 6, 14, 12, tzinfo=UTC)
EPOCH0 = int(T0.timestamp())

NULLABLE = T.StructType([T.StructField(f.name, f.dataType) for f in bronze_schema().fields])

CLEAN = {
    "icao24": "3c6444",
    "callsign": "DLH9LH",
    "origin_country": "Germany",
    "event_time": T0,
    "time_position": EPOCH0,
    "last_contact": EPOCH0 + 1,
    "longitude": 8.5,
    "latitude": 50.0,
    "baro_altitude": 10000.0,
    "geo_altitude": 10100.0,
    "on_ground": False,
    "velocity": 230.5,
    "true_track": 90.0,
    "vertical_rate": 0.0,
    "squawk": "1000",
    "spi": False,
    "position_source": 0,
    "category": 1,
    "ingest_time": T0 + timedelta(seconds=30),
    "ingest_batch_id": "b1",
    "source_name": "feed",
}


def row(**changes):
    return {**CLEAN, **changes}


def at(seconds, icao24="3c6444", **changes):
    """A clean row observed some seconds after the first one."""
    return row(
        icao24=icao24,
        event_time=T0 + timedelta(seconds=seconds),
        time_position=EPOCH0 + seconds,
        last_contact=EPOCH0 + seconds + 1,
        **changes,
    )


def frame(spark, rows, extra=()):
    """Bronze rows as a DataFrame; ``extra`` names further long columns."""
    schema = T.StructType(list(NULLABLE.fields))
    for name in extra:
        schema = schema.add(name, T.LongType())
    names = [*BRONZE_COLUMNS, *extra]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def announce(spark, *batches):
    """Batches as ``(batch_id, seconds after the first moment)``."""
    return spark.createDataFrame(
        [(b, "feed", T0 + timedelta(seconds=s)) for b, s in batches], BATCH_SCHEMA
    )
