"""The bronze table: 21 columns, the logical key and the partition layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# Bronze columns in table order as (name, type, required). Field ids count from 1.
BRONZE_FIELDS = (
    ("icao24", "string", True),
    ("callsign", "string", False),
    ("origin_country", "string", False),
    ("event_time", "timestamp", True),
    ("time_position", "bigint", False),
    ("last_contact", "bigint", True),
    ("longitude", "double", False),
    ("latitude", "double", False),
    ("baro_altitude", "double", False),
    ("geo_altitude", "double", False),
    ("on_ground", "boolean", True),
    ("velocity", "double", False),
    ("true_track", "double", False),
    ("vertical_rate", "double", False),
    ("squawk", "string", False),
    ("spi", "boolean", False),
    ("position_source", "int", False),
    ("category", "int", False),
    ("ingest_time", "timestamp", True),
    ("ingest_batch_id", "string", True),
    ("source_name", "string", True),
)

SPARK_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}

# The type names table facts report, by Spark type name.
FACT_TYPES = {
    "string": "string",
    "bigint": "long",
    "int": "int",
    "double": "double",
    "boolean": "boolean",
    "timestamp": "timestamptz",
}

BRONZE_COLUMNS = tuple(name for name, _, _ in BRONZE_FIELDS)
REQUIRED_COLUMNS = tuple(name for name, _, required in BRONZE_FIELDS if required)
STATE_KEY = ("icao24", "last_contact")


def bronze_schema() -> T.StructType:
    """The bronze columns as a Spark schema; required columns are not nullable."""
    schema = T.StructType()
    for name, type_name, required in BRONZE_FIELDS:
        schema.add(name, SPARK_TYPES[type_name], not required)
    return schema
