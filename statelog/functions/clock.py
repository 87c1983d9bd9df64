"""UTC arithmetic on instants. Nothing here depends on the session time zone."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per interval a read may bucket by.
INTERVALS = {"hour": 3600, "day": 86400}

# Epoch seconds of years 1 to 9999, the span a timestamp may have.
MIN_EPOCH, MAX_EPOCH = -62135596800, 253402300799

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def to_utc(moment: datetime) -> datetime:
    """A datetime in UTC; one without a zone already means UTC."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def epoch_micros(moment: datetime) -> int:
    return (to_utc(moment) - _EPOCH) // timedelta(microseconds=1)


def utc_literal(moment: datetime) -> Column:
    """A foldable timestamp literal, so that comparisons with it reach the Parquet scan."""
    return F.timestamp_micros(F.lit(epoch_micros(moment)))


def event_time(time_position: Column, last_contact: Column) -> Column:
    """Observation time: the position's epoch seconds, else the contact's; NULL if unusable."""
    epoch = F.coalesce(time_position, last_contact).cast("bigint")
    return F.when(epoch.between(MIN_EPOCH, MAX_EPOCH), F.timestamp_seconds(epoch))


def utc_hour_number(moment: Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_seconds(moment) / 3600).cast("bigint")


def utc_day(moment: Column) -> Column:
    """The UTC calendar day."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86400).cast("int"))


def utc_bucket(moment: Column, interval: str) -> Column:
    """Start of the UTC hour or day that holds the instant."""
    seconds = INTERVALS[interval]
    return F.timestamp_seconds(F.floor(F.unix_seconds(moment) / seconds) * seconds)
