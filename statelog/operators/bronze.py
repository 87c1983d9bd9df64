"""Raw records to typed bronze rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelog.functions.clock import event_time
from statelog.functions.text import clean_callsign
from statelog.schema import BRONZE_FIELDS


def to_bronze(
    records: DataFrame,
    ingest_time: Column,
    ingest_batch_id: Column,
    source_name: Column,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Map raw records to the 21 bronze columns in one projection.

    A column the records lack is NULL. A record without a usable time keeps its row with a NULL
    ``event_time``, for the gate to reject. ``keep`` carries further columns along in front.
    """

    def raw(name: str) -> Column:
        return F.col(name) if name in records.columns else F.lit(None)

    derived = {
        "callsign": clean_callsign(raw("callsign").cast("string")),
        "event_time": event_time(raw("time_position"), raw("last_contact")),
        "ingest_time": ingest_time,
        "ingest_batch_id": ingest_batch_id,
        "source_name": source_name,
    }
    columns = [
        derived.get(name, raw(name)).cast(type_name).alias(name)
        for name, type_name, _ in BRONZE_FIELDS
    ]
    return records.select(*keep, *columns)
