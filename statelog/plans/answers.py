"""The read queries on a log: arguments as callers give them, and the snapshot that answered."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from statelog.operators import diagnosis, reads
from statelog.plans.log import StateLog


@dataclass(frozen=True)
class Answer:
    """Result rows, the id of the snapshot they come from (None for an empty log), and the limit in
    force (None where there is no page)."""

    snapshot_id: int | None
    rows: DataFrame
    limit: int | None = None

    def count(self) -> int:
        """Rows returned; counts them."""
        return self.rows.count()


def flights(
    log: StateLog,
    icao24: str | None = None,
    callsign: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
    offset: int = 0,
    as_of_snapshot_id: int | None = None,
    as_of_timestamp: datetime | None = None,
    maximum: int = reads.MAX_LIMIT,
    after=None,
) -> Answer:
    """A page of the rows that pass the filters, of ``maximum`` rows at most; for ``after`` see
    :func:`statelog.operators.reads.page`.

    Where only time limits the rows, the log's hourly counts tell which hours hold the page, however
    deep it is, and no other hour is read.
    """
    limit = reads.clamp_limit(limit, maximum=maximum)
    reads.check_page(limit, offset)
    snapshot = log.at(as_of_snapshot_id, as_of_timestamp)
    if icao24 is None and callsign is None and after is None:
        part = snapshot.page_window(offset, limit, start, end)
        if part is None:
            return Answer(snapshot.snapshot_id, snapshot.scan().limit(0), limit)
        start, end, offset = part
    rows = snapshot.scan(icao24, callsign, start, end)
    return Answer(snapshot.snapshot_id, reads.page(rows, limit, offset, after), limit)


def bounding_box(
    log: StateLog,
    min_lat: float,
    max_lat: float,
    min_lon: float,
    max_lon: float,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
    offset: int = 0,
    as_of_snapshot_id: int | None = None,
    as_of_timestamp: datetime | None = None,
    maximum: int = reads.MAX_LIMIT,
    after=None,
) -> Answer:
    """A page of the rows inside a box and a time window; an inverted box is empty."""
    limit = reads.clamp_limit(limit, maximum=maximum)
    reads.check_page(limit, offset)
    reads.check_box(min_lat, max_lat, min_lon, max_lon)
    snapshot = log.at(as_of_snapshot_id, as_of_timestamp)
    rows = snapshot.scan(start=start, end=end, box=(min_lat, max_lat, min_lon, max_lon))
    return Answer(snapshot.snapshot_id, reads.page(rows, limit, offset, after), limit)


def latest_state(
    log: StateLog,
    icao24: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    as_of_snapshot_id: int | None = None,
    as_of_timestamp: datetime | None = None,
    maximum: int = reads.MAX_LIMIT,
) -> Answer:
    """A page, by aircraft, of each aircraft's newest row, from the log's reduced rows."""
    limit = reads.clamp_limit(limit, maximum=maximum)
    reads.check_page(limit, offset)
    snapshot = log.at(as_of_snapshot_id, as_of_timestamp)
    newest = reads.latest_page(snapshot.newest(icao24), limit, offset)
    return Answer(snapshot.snapshot_id, newest, limit)


def stats_per_interval(
    log: StateLog,
    interval: str = "hour",
    start: datetime | None = None,
    end: datetime | None = None,
    group_by: str | None = None,
    as_of_snapshot_id: int | None = None,
    as_of_timestamp: datetime | None = None,
) -> Answer:
    """Row counts per UTC hour or day, optionally per country, from the log's hourly counts."""
    reads.check_stats(interval, group_by)
    snapshot = log.at(as_of_snapshot_id, as_of_timestamp)
    return Answer(snapshot.snapshot_id, snapshot.interval_counts(interval, start, end, group_by))


def diagnose_flights(
    log: StateLog,
    icao24: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    sample_limit: int | None = None,
    as_of_snapshot_id: int | None = None,
    max_rows: int = reads.MAX_LIMIT,
) -> DataFrame:
    """The diagnosis record of a bounded sample: the first rows that pass the filters."""
    limit = diagnosis.sample_limit(sample_limit, max_rows)
    sample = flights(
        log, icao24, start=start, end=end, limit=limit, as_of_snapshot_id=as_of_snapshot_id,
        maximum=max_rows,
    )
    return diagnosis.diagnose(sample.rows, sample.snapshot_id, requested_limit=sample.limit)
