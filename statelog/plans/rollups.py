"""Results kept up to date with a log: the newest row per aircraft, and counts per hour.

Layout under the root of the log::

    rollups/newest/level-0/node-N/*.parquet   the rows of write N + 1, reduced commit by commit
    rollups/newest/level-K/node-N/*.parquet   FAN_IN nodes of the level below, reduced to one
    rollups/hours/...                         the same for counts by hour and country

Both results can be merged, a maximum and a sum. A read as of a snapshot needs the nodes that cover
the writes before the snapshot's own, fewer than FAN_IN of each level, and of its own write the
commits up to it. So it reads rows that grow with aircraft, or hours, and with the logarithm of the
history. Every write adds its node, and the nodes it completes on the levels above, before the batch
log names it: a committed write always has them, and what a failed write left is overwritten or never
asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statelog.functions.clock import epoch_micros, utc_hour_number
from statelog.operators.reads import newest_per

#: Nodes that make one of the level above.
FAN_IN = 8
HOUR_FIELDS = "event_hour bigint, origin_country string, n bigint"
_HOUR_MICROS = 3_600_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass(frozen=True)
class Rollup:
    """A result by name: how rows with further keys are reduced, and how nodes are merged."""

    name: str
    of_rows: Callable[[DataFrame], DataFrame]
    merged: Callable[[DataFrame], DataFrame]

    def path(self, root: str, level: int, node: int) -> str:
        return f"{root}/rollups/{self.name}/level-{level}/node-{node}"


def _hours(rows: DataFrame) -> DataFrame:
    hour = utc_hour_number(F.col("event_time")).alias("event_hour")
    return rows.groupBy("commit_seq", hour, "origin_country").agg(F.count(F.lit(1)).alias("n"))


def _sum_of_hours(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("event_hour", "origin_country").agg(F.sum("n").alias("n"))


NEWEST = Rollup("newest", lambda rows: newest_per(rows, "commit_seq", "icao24"), lambda nodes: newest_per(nodes, "icao24"))
HOURS = Rollup("hours", _hours, _sum_of_hours)
ROLLUPS = (NEWEST, HOURS)


def cover(writes: int) -> list[tuple[int, int]]:
    """The fewest nodes, as level and number, that hold the first ``writes`` writes."""
    nodes, level = [], 0
    while writes:
        nodes += [(level, node) for node in range(writes // FAN_IN * FAN_IN, writes)]
        writes, level = writes // FAN_IN, level + 1
    return nodes


def completed(write_id: int) -> list[tuple[int, int]]:
    """The nodes above the first level that a write is the last one of."""
    nodes, level = [], 1
    while write_id % FAN_IN**level == 0:
        nodes.append((level, write_id // FAN_IN**level - 1))
        level += 1
    return nodes


def extend(spark: SparkSession, root: str, rows: DataFrame, schema: T.StructType, write_id: int) -> None:
    """Add the nodes of a write whose ``rows``, with ``commit_seq``, are in files already."""
    for rollup in ROLLUPS:
        _store(rollup.of_rows(rows), rollup, rollup.path(root, 0, write_id - 1))
        for level, node in completed(write_id):
            below = [(level - 1, node * FAN_IN + i) for i in range(FAN_IN)]
            _store(rollup.merged(_read(spark, root, rollup, schema, below)), rollup, rollup.path(root, level, node))


def _store(rows: DataFrame, rollup: Rollup, path: str) -> None:
    if rollup is NEWEST:
        # One aircraft's row is then found by the row groups' bounds.
        rows = rows.sortWithinPartitions("icao24")
    rows.write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, root: str, rollup: Rollup, schema: T.StructType, nodes: list) -> DataFrame:
    """The rows of some nodes; those above the first level have no ``commit_seq``."""
    fields = schema if rollup is NEWEST else T.StructType.fromDDL(HOUR_FIELDS)
    kept = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]).add("commit_seq", T.LongType())
    paths = [rollup.path(root, level, node) for level, node in nodes]
    return spark.read.schema(kept).parquet(*paths) if paths else spark.createDataFrame([], kept)


def as_of(
    spark: SparkSession, root: str, rollup: Rollup, schema: T.StructType, write_id: int, commit_seq: int | None
) -> DataFrame:
    """Rows whose merger is the result after a commit of a write; the whole write without one."""
    if commit_seq is None:
        return _read(spark, root, rollup, schema, cover(write_id)).drop("commit_seq")
    nodes = [*cover(write_id - 1), (0, write_id - 1)]
    rows = _read(spark, root, rollup, schema, nodes)
    return rows.where(F.col("commit_seq").isNull() | (F.col("commit_seq") <= commit_seq)).drop("commit_seq")


def full_hours(start: datetime | None, end: datetime | None) -> tuple[int | None, int | None]:
    """First and last hour that lie in a window whole; both bounds of the window belong to it."""
    first = None if start is None else -(-epoch_micros(start) // _HOUR_MICROS)
    last = None if end is None else (epoch_micros(end) + 1) // _HOUR_MICROS - 1
    return first, last


def edges(start: datetime | None, end: datetime | None) -> list[tuple[datetime, datetime]]:
    """The parts of a window outside its full hours, as windows of less than an hour each."""
    first, last = full_hours(start, end)
    if first is not None and last is not None and first > last:
        return [(start, end)] if epoch_micros(start) <= epoch_micros(end) else []
    out = []
    if first is not None and epoch_micros(start) < first * _HOUR_MICROS:
        out.append((start, _moment(first * _HOUR_MICROS - 1)))
    if last is not None and epoch_micros(end) >= (last + 1) * _HOUR_MICROS:
        out.append((_moment((last + 1) * _HOUR_MICROS), end))
    return out


def hour_bounds(first: int, last: int) -> tuple[datetime, datetime]:
    """The first and the last instant of the hours that start at these microseconds."""
    return _moment(first), _moment(last + _HOUR_MICROS - 1)


def _moment(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)
