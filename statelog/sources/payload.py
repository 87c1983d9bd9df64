"""Landed poll payloads: JSON documents whose ``states`` are positional, mixed-type arrays.

A poll is landed under ``source_name=<feed>/poll_id=<number>/`` as one or more text files. A line is one document
``{"time": ..., "seq": ..., "states": [[...], ...]}``; a poll too large for one document is landed
as several, numbered by ``seq``, so that no task has to hold a whole poll. A finished poll is
announced by one JSON line in the arrivals folder with its provenance.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 18 positions of a state, in payload order, with their bronze types.
POSITIONS = (
    ("icao24", "string"),
    ("callsign", "string"),
    ("origin_country", "string"),
    ("time_position", "bigint"),
    ("last_contact", "bigint"),
    ("longitude", "double"),
    ("latitude", "double"),
    ("baro_altitude", "double"),
    ("on_ground", "boolean"),
    ("velocity", "double"),
    ("true_track", "double"),
    ("vertical_rate", "double"),
    ("sensors", None),
    ("geo_altitude", "double"),
    ("squawk", "string"),
    ("spi", "boolean"),
    ("position_source", "int"),
    ("category", "int"),
)

PAYLOAD_SCHEMA = "seq bigint, states array<array<string>>, _unreadable string"
LANDING_SCHEMA = "value string, source_name string, poll_id bigint"
ARRIVAL_SCHEMA = "poll_id bigint, source_name string, ingest_time timestamp"

# Order of records within a poll: document number, then position in its states.
RECORD_ORDER = ("seq", "pos")


def read_landed(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    """Documents of landed polls as ``(value, source_name, poll_id)``; none before the first lands.

    ``whole_files`` is for multi-line documents. Spark lists the folders, on the executors where
    there are many, and filters on the poll prune them; how a number is padded does not matter.
    """
    reader = spark.read.format("text").schema(LANDING_SCHEMA).option("wholetext", whole_files)
    try:
        return reader.load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LANDING_SCHEMA)


def read_landed_stream(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the documents of landed polls, announced or not, in the order their files appear."""
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)


def read_arrivals_stream(
    spark: SparkSession, folder: str, polls_per_trigger: int | None = None
) -> DataFrame:
    """Stream of poll announcements, one file per poll."""
    reader = spark.readStream.schema(ARRIVAL_SCHEMA).option("timeZone", "UTC")
    if polls_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", polls_per_trigger)
    return reader.json(folder)


def _whole_number(text: Column) -> Column:
    """A whole number, cut towards zero when written with a fraction or an exponent."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def _typed(text: Column, type_name: str) -> Column:
    if type_name == "bigint":
        return _whole_number(text)
    if type_name == "int":
        return _whole_number(text).try_cast("int")
    if type_name == "string":
        return text
    return text.try_cast(type_name)


def decode_states(documents: DataFrame, value: str = "value") -> DataFrame:
    """One named record per state; a missing or unreadable position is NULL.

    ``documents`` keeps its other columns. ``states`` null or absent gives no records. An unreadable
    document gives one record of NULLs, for the gate to reject its poll. ``sensors`` is dropped.
    Adds ``seq`` and ``pos``, the record's place in its poll.
    """
    kept = [name for name in documents.columns if name != value]
    payload = F.from_json(value, PAYLOAD_SCHEMA, {"columnNameOfCorruptRecord": "_unreadable"})
    no_positions = F.array(F.array().cast("array<string>"))
    states = (
        documents.where(F.trim(value) != "")
        .select(*kept, payload.alias("payload"))
        .select(
            *kept,
            F.coalesce("payload.seq", F.lit(0)).cast("bigint").alias("seq"),
            F.posexplode(
                F.when(F.col("payload._unreadable").isNotNull(), no_positions).otherwise(
                    F.col("payload.states")
                )
            ).alias("pos", "state"),
        )
    )
    fields = [
        _typed(F.get(F.col("state"), F.lit(index)), type_name).alias(name)
        for index, (name, type_name) in enumerate(POSITIONS)
        if type_name is not None
    ]
    return states.select(*kept, "seq", F.col("pos").cast("bigint").alias("pos"), *fields)
