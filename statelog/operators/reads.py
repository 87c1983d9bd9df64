"""Read queries on state vectors: filters, pages, bounding box, latest state, interval counts."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statelog.functions.clock import INTERVALS, utc_bucket, utc_day, utc_literal
from statelog.schema import BRONZE_COLUMNS

# Page sizes, groupings and the columns of a sample.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
GROUPINGS = ("origin_country",)
SAMPLE_COLUMNS = (
    "icao24",
    "callsign",
    "event_time",
    "latitude",
    "longitude",
    "velocity",
    "position_source",
    "source_name",
)
SAMPLE_ROWS = 5

PAGE_KEY = ("event_time", "icao24")
LATEST_KEY = ("last_contact", "event_time", "ingest_time")


def clamp_limit(
    limit: int | None, default: int = DEFAULT_LIMIT, maximum: int = MAX_LIMIT
) -> int:
    """Requested or default page size, never above the maximum."""
    return min(default if limit is None else limit, maximum)


def check_page(limit: int, offset: int) -> None:
    if limit < 1:
        raise ValueError(f"limit must be >= 1, got {limit}")
    if offset < 0:
        raise ValueError(f"offset must be >= 0, got {offset}")


def check_box(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> None:
    for name, value, bound in (
        ("min_lat", min_lat, 90),
        ("max_lat", max_lat, 90),
        ("min_lon", min_lon, 180),
        ("max_lon", max_lon, 180),
    ):
        if not -bound <= value <= bound:
            raise ValueError(f"{name} must be within -{bound}..{bound}, got {value}")


def check_stats(interval: str, group_by: str | None) -> None:
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {tuple(INTERVALS)}, got {interval!r}")
    if group_by is not None and group_by not in GROUPINGS:
        raise ValueError(f"group_by must be one of {GROUPINGS}, got {group_by!r}")


def row_filter(
    icao24: str | None = None,
    callsign: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> Column:
    """Conjunction of the given filters, both time bounds inclusive; always true without any."""
    parts = []
    if icao24 is not None:
        parts.append(F.col("icao24") == icao24)
    if callsign is not None:
        parts.append(F.col("callsign") == callsign)
    if start is not None:
        parts.append(F.col("event_time") >= utc_literal(start))
    if end is not None:
        parts.append(F.col("event_time") <= utc_literal(end))
    return reduce(and_, parts) if parts else F.lit(True)


def box_filter(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Inside the box, edges included; no wrap at the antimeridian, and NULL is never inside."""
    return F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(
        min_lon, max_lon
    )


def _rest(rows: DataFrame, key: tuple[str, ...]) -> list[str]:
    """Columns that break ties after the key, which makes an order total up to equal rows."""
    return [name for name in BRONZE_COLUMNS if name in rows.columns and name not in key]


def page_order(rows: DataFrame) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in (*PAGE_KEY, *_rest(rows, PAGE_KEY))]


def _beyond(rows: DataFrame, row) -> Column:
    """Rows after ``row`` in page order; NULLs come last in every column."""
    later, equal = F.lit(False), F.lit(True)
    for name in (*PAGE_KEY, *_rest(rows, PAGE_KEY)):
        value, column = row[name], F.col(name)
        if value is None:
            equal = equal & column.isNull()
            continue
        held = utc_literal(value) if isinstance(value, datetime) else F.lit(value)
        later = later | (equal & (column.isNull() | (column > held)))
        equal = equal & (column == held)
    return later


def _from_day_of(rows: DataFrame, row) -> DataFrame:
    """Without the days and moments before ``row``, as filters that reach the scan."""
    moment = row["event_time"]
    if moment is None:
        return rows.where("event_time is null")
    held = utc_literal(moment)
    rows = rows.where((F.col("event_time") >= held) | F.col("event_time").isNull())
    if "event_day" in rows.columns:
        rows = rows.where((F.col("event_day") >= utc_day(held)) | F.col("event_day").isNull())
    return rows


def page(
    rows: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, after=None
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order of event time and aircraft.

    One top-k plan for every page; it keeps ``offset + limit`` rows per task. ``after`` is a row of
    an earlier page, usually its last: the page then starts behind it, reads nothing from before its
    day and needs no offset, however deep it is. A row equal to it in all columns counts as read.
    """
    check_page(limit, offset)
    if after is not None:
        rows = _from_day_of(rows, after).where(_beyond(rows, after))
    return rows.orderBy(*page_order(rows)).offset(offset).limit(limit)


def flights(
    rows: DataFrame,
    icao24: str | None = None,
    callsign: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """A page of the rows that pass the filters."""
    return page(rows.where(row_filter(icao24, callsign, start, end)), limit, offset)


def bounding_box(
    rows: DataFrame,
    min_lat: float,
    max_lat: float,
    min_lon: float,
    max_lon: float,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """A page of the rows inside a box and a time window; an inverted box is empty."""
    check_box(min_lat, max_lat, min_lon, max_lon)
    inside = row_filter(start=start, end=end) & box_filter(min_lat, max_lat, min_lon, max_lon)
    return page(rows.where(inside), limit, offset)


def newest_per(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key, by contact, then event, then ingest time, then the other columns.

    NULL is a key of its own. The rank filter is applied within each map task first, so a key with a
    large share of all rows sends one row per task.
    """
    names = [*LATEST_KEY, *_rest(rows, LATEST_KEY)]
    names += [n for n in rows.columns if n not in names and n not in keys]
    window = Window.partitionBy(*keys).orderBy(*[F.col(n).desc_nulls_last() for n in names])
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def newest_per_aircraft(rows: DataFrame) -> DataFrame:
    """The newest row of each aircraft; NULL is an aircraft of its own."""
    return newest_per(rows, "icao24")


def latest_state(
    rows: DataFrame, icao24: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0
) -> DataFrame:
    """A page, by aircraft, of each aircraft's newest row."""
    check_page(limit, offset)
    return latest_page(newest_per_aircraft(rows.where(row_filter(icao24=icao24))), limit, offset)


def latest_page(newest: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A page, by aircraft, of rows of which each aircraft has one."""
    check_page(limit, offset)
    return newest.orderBy(F.col("icao24").asc_nulls_last()).offset(offset).limit(limit)


def stats_per_interval(
    rows: DataFrame,
    interval: str = "hour",
    start: datetime | None = None,
    end: datetime | None = None,
    group_by: str | None = None,
) -> DataFrame:
    """Row counts per UTC hour or day, optionally per country; a NULL country is a group.

    Where the scan offers its partition day, whole-range daily counts group by that and read no
    event times from the files.
    """
    check_stats(interval, group_by)
    if interval == "day" and "event_day" in rows.columns:
        bucket = F.timestamp_seconds(F.unix_date("event_day").cast("bigint") * INTERVALS["day"])
    else:
        bucket = utc_bucket(F.col("event_time"), interval)
    counted = rows.where(row_filter(start=start, end=end))
    return _counts(counted, bucket, group_by, F.count(F.lit(1)))


def stats_of_hours(hours: DataFrame, interval: str = "hour", group_by: str | None = None) -> DataFrame:
    """The same from counts ``event_hour, origin_country, n``, which may hold a key more than once."""
    check_stats(interval, group_by)
    seconds = INTERVALS[interval]
    start = F.floor(F.col("event_hour") * INTERVALS["hour"] / seconds) * seconds
    return _counts(hours, F.timestamp_seconds(start), group_by, F.sum("n"))


def _counts(rows: DataFrame, bucket: Column, group_by: str | None, count: Column) -> DataFrame:
    keys = [bucket.alias("bucket_start")]
    if group_by is not None:
        keys.append(F.col(group_by).alias("group"))
    counts = rows.groupBy(*keys).agg(count.alias("count"))
    if group_by is None:
        counts = counts.select("bucket_start", F.lit(None).cast("string").alias("group"), "count")
    return counts.orderBy(
        F.col("bucket_start").asc_nulls_last(), F.col("group").asc_nulls_last()
    )


def source_profile(rows: DataFrame) -> DataFrame:
    """Row count and event-time span per source."""
    return rows.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_time").alias("min_event"),
        F.max("event_time").alias("max_event"),
    )


def row_sample(rows: DataFrame) -> DataFrame:
    """The first rows, in page order, cut to the sample columns."""
    return page(rows, SAMPLE_ROWS).select(*SAMPLE_COLUMNS)


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))


def value_count(rows: DataFrame, column: str, value: object) -> DataFrame:
    """Rows in which a column equals a value; 0 where there is no such column."""
    hit = F.col(column) == F.lit(value) if column in rows.columns else F.lit(False)
    return rows.agg(F.count_if(hit).alias("n_rows"))
