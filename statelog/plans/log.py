"""The snapshot log: an append-only Parquet table with a ledger of committed batches.

Layout under the root::

    data/spec_id=K/write_id=W/<partition>=.../*.parquet   rows, each with its commit_seq
    ledger/entry=N/*.parquet                              one row per ingested batch, written last
    settings/version=N/*.parquet                          schema and partition layout in force
    expired/run=N/*.parquet                               expired snapshots

A snapshot is a ledger row with status ``appended``. Its row carries the schema it was written
under and the write ids of each partition layout up to it, so a read needs that one row to know
which files and columns to scan. One write may hold the rows of many batches; each batch is a
snapshot of its own through ``commit_seq``.

A write id is the newest committed one plus one, and its folder is overwritten. What a failed write
left behind therefore always lies above every committed id, and no read looks there. One writer per
log is assumed; it keeps in mind what it has committed and looks it up again only if it finds that
another object has written since.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statelog.functions.clock import epoch_micros, to_utc, utc_day, utc_hour_number, utc_literal
from statelog.functions.place import cell, cell_ranges, in_ranges
from statelog.operators.quality import batch_report
from statelog.operators.reads import box_filter, newest_per_aircraft, row_filter, stats_of_hours
from statelog.plans import rollups
from statelog.schema import FACT_TYPES, SPARK_TYPES, bronze_schema

APPENDED, SKIPPED, ABORTED = "appended", "skipped_empty", "dq_aborted"
# Announced without a document; the batch is taken when it is announced again.
MISSING = "missing_documents"

BATCH_ID = "ingest_batch_id"
HOUR_MILLIS = 3_600_000
#: Stored with each row for the scan, like ``commit_seq``, and never shown.
CELL = "_cell"

# Rows of a few short columns each; beyond this many, Spark chooses the join.
BROADCAST_BATCHES = 50_000

_LAYOUT = "array<struct<spec_id: int, transform: string, first_write: bigint, last_write: bigint>>"

LEDGER_FIELDS = (
    ("batch_id", "string"),
    ("source_name", "string"),
    ("ingest_time", "timestamp"),
    ("stream_batch", "string"),
    ("status", "string"),
    ("rows_in", "bigint"),
    ("rows_written", "bigint"),
    ("n_failures", "bigint"),
    ("n_warnings", "bigint"),
    ("lag_seconds", "double"),
    ("current_snapshot_id", "bigint"),
    ("snapshot_count", "bigint"),
    ("snapshot_id", "bigint"),
    ("sequence_number", "bigint"),
    ("timestamp_ms", "bigint"),
    ("operation", "string"),
    ("schema_json", "string"),
    ("write_id", "bigint"),
    ("commit_seq", "bigint"),
    ("layout", _LAYOUT),
    ("total_rows", "bigint"),
    ("summary", "map<string, string>"),
)
LEDGER_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in LEDGER_FIELDS) + ", entry bigint"
CHANGE_SCHEMA = "schema_json string, spec_id int, transform string"
SETTINGS_SCHEMA = CHANGE_SCHEMA + ", version bigint"
EXPIRED_SCHEMA = (
    "snapshot_id bigint, timestamp_ms bigint, sequence_number bigint, expired_at timestamp, "
    "run bigint"
)
BATCH_SCHEMA = "batch_id string, source_name string, ingest_time timestamp"


class AsOfConflictError(ValueError):
    """Both a snapshot id and a timestamp were given."""


class SnapshotNotFoundError(LookupError):
    """No snapshot has the id, or none is as old as the timestamp."""


@dataclass(frozen=True)
class Head:
    """What a writer has to know of a log: numbers of its last files, and its newest snapshot."""

    settings: Row
    entry: int
    expired_run: int
    n_commits: int
    n_expired: int
    #: ``write_id, commit_seq, total_rows, timestamp_ms, layout`` of the newest commit, if any.
    newest: dict | None


@dataclass(frozen=True)
class Transform:
    """A partition layout: the column it adds, its type and how it follows from event time."""

    column: str
    type_name: str
    of: Callable[[Column], Column]

    def prune(self, start: datetime | None, end: datetime | None) -> Column:
        """The range of partition values that a window on event time implies."""
        kept = F.lit(True)
        if start is not None:
            kept = kept & (F.col(self.column) >= self.of(utc_literal(start)))
        if end is not None:
            kept = kept & (F.col(self.column) <= self.of(utc_literal(end)))
        return kept


# The partition layouts a log may have.
TRANSFORMS = {
    "day": Transform("event_day", "date", utc_day),
    "hour": Transform("event_hour", "bigint", utc_hour_number),
}


def newest_first() -> list[Column]:
    """Snapshots by time, then by sequence number, a missing number last."""
    return [F.col("timestamp_ms").desc(), F.coalesce("sequence_number", F.lit(-1)).desc()]


def snapshot_at(snapshots: DataFrame, moment: datetime) -> DataFrame:
    """The newest snapshot at or before a moment, to the millisecond."""
    at_ms = epoch_micros(moment) // 1000
    return snapshots.where(F.col("timestamp_ms") <= at_ms).orderBy(*newest_first()).limit(1)


def snapshots_at(snapshots: DataFrame, moments: DataFrame, moment: str) -> DataFrame:
    """Each row of ``moments`` with ``snapshot_id``, the newest snapshot at or before its ``moment``.

    The id is NULL where no snapshot is as old, and for a NULL moment. Snapshots are gathered hour by
    hour, each hour with the last snapshot before it; rows meet those of their hour in one equality
    join, which Spark may split where many rows share an hour. One task handles a row for each hour.
    """
    millis = F.floor(F.unix_micros(F.col(moment)) / 1000)
    placed = moments.withColumns({"_at_ms": millis, "_at_hour": F.floor(millis / HOUR_MILLIS)})
    held = F.struct("timestamp_ms", F.coalesce("sequence_number", F.lit(-1)).alias("seq"), "snapshot_id")
    hours = snapshots.groupBy(F.floor(F.col("timestamp_ms") / HOUR_MILLIS).alias("_hour")).agg(
        F.array_sort(F.collect_list(held)).alias("_held"))
    asked = placed.select(F.col("_at_hour").alias("_hour")).where("_hour is not null").distinct()
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.element_at("_held", -1)
    each = hours.join(asked, "_hour", "full").select(
        "_hour", "_held", F.last(newest, ignorenulls=True).over(before).alias("_before"))
    found = placed.join(each, F.col("_at_hour") == F.col("_hour"), "left")
    # Both are in order, so the last one that fits is the newest.
    here = F.filter("_held", lambda s: s["timestamp_ms"] <= F.col("_at_ms"))
    last = F.coalesce(F.when(F.size(here) > 0, F.element_at(here, -1)), F.col("_before"))
    return found.select(*moments.columns, last["snapshot_id"].alias("snapshot_id"))


def expirable(snapshots: DataFrame, retain_last: int, protected: DataFrame | None = None) -> DataFrame:
    """The snapshots older than the newest ``retain_last``, newest first.

    ``protected`` holds ids that must stay, such as heads of branches and tags. The current snapshot
    stays as well. The cut-off is one top-k lookup; no single task sorts all snapshots.
    """
    if retain_last < 1:
        raise ValueError("retain_last must be >= 1")
    cutoff = snapshots.orderBy(*newest_first()).offset(retain_last - 1).limit(1).first()
    if cutoff is None:
        return snapshots.select("snapshot_id", "timestamp_ms", "sequence_number").limit(0)
    cut_seq = cutoff["sequence_number"] if cutoff["sequence_number"] is not None else -1
    older = (F.col("timestamp_ms") < cutoff["timestamp_ms"]) | (
        (F.col("timestamp_ms") == cutoff["timestamp_ms"])
        & (F.coalesce("sequence_number", F.lit(-1)) < cut_seq)
    )
    current = snapshots.agg(F.max("sequence_number").alias("sequence_number"))
    gone = snapshots.where(older).join(current, "sequence_number", "left_anti")
    if protected is not None:
        gone = gone.join(protected, "snapshot_id", "left_anti")
    return gone.orderBy(*newest_first()).select("snapshot_id", "timestamp_ms", "sequence_number")


def broadcast_if_few(batches: DataFrame, count: int) -> DataFrame:
    """A table with a row per batch, broadcast while its counted rows are few."""
    return F.broadcast(batches) if count <= BROADCAST_BATCHES else batches


def must_not_be_null(column: Column, name: str) -> Column:
    """The column itself; a NULL fails the task that writes it."""
    return F.when(
        column.isNull(), F.raise_error(F.lit(f"required column {name} is null"))
    ).otherwise(column)


class StateLog:
    """One log under a folder. Metadata lookups are single rows; data stays in DataFrames."""

    def __init__(self, spark: SparkSession, root: str, identifier: str = "bronze.state_vectors"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.identifier = identifier
        self._known: Head | None = None

    # ------------------------------------------------------------------ metadata tables

    def _table(self, name: str, schema: str) -> DataFrame:
        """A metadata table; empty before its first row is written."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def batch_log(self) -> DataFrame:
        """One row per ingested batch, whatever became of it."""
        return self._table("ledger", LEDGER_SCHEMA)

    def commits(self) -> DataFrame:
        """All snapshots ever committed, the expired ones too."""
        return self.batch_log().where(F.col("status") == APPENDED)

    def expired(self) -> DataFrame:
        return self._table("expired", EXPIRED_SCHEMA)

    def snapshots(self) -> DataFrame:
        """Snapshots that can still be read by id or time."""
        return self.commits().join(self.expired().select("snapshot_id"), "snapshot_id", "left_anti")

    def list_snapshots(self) -> DataFrame:
        """Id, UTC time, operation and summary of each snapshot, oldest first."""
        return (
            self.snapshots()
            .orderBy("sequence_number")
            .select(
                "snapshot_id",
                F.timestamp_millis("timestamp_ms").alias("timestamp"),
                "operation",
                "summary",
            )
        )

    def history(self) -> DataFrame:
        return self.snapshots().orderBy("sequence_number").select("snapshot_id", "timestamp_ms")

    def state(self) -> DataFrame:
        """One row: current snapshot id and snapshot count; NULL and 0 for an empty log."""
        return self.snapshots().agg(
            F.max_by("snapshot_id", "sequence_number").alias("snapshot_id"),
            F.count(F.lit(1)).alias("snapshot_count"),
        )

    # ------------------------------------------------------------------ schema and layout

    def _settings(self):
        """Schema and layout in force now, as one row."""
        newest = (
            self._table("settings", SETTINGS_SCHEMA).orderBy(F.col("version").desc()).limit(1).first()
        )
        if newest is not None:
            return newest
        return Row(schema_json=bronze_schema().json(), spec_id=0, transform="day", version=0)

    def _change(self, schema_json: str, spec_id: int, transform: str, version: int) -> None:
        row = self.spark.createDataFrame(
            [(schema_json, spec_id, transform)], CHANGE_SCHEMA
        )
        _overwrite(row).parquet(f"{self.root}/settings/version={version}")

    def schema(self) -> T.StructType:
        return _schema_of(self._settings()["schema_json"])

    def add_column(self, name: str, type_name: str) -> None:
        """Add a nullable column for rows to come; rows already there read NULL in it."""
        now = self._settings()
        schema = _schema_of(now["schema_json"])
        if name in schema.names:
            raise ValueError(f"column {name} exists")
        schema = schema.add(name, T.DataType.fromDDL(type_name), True)
        self._change(schema.json(), now["spec_id"], now["transform"], now["version"] + 1)

    def repartition_by(self, transform: str) -> None:
        """Partition future writes by ``day`` or ``hour``; files already there stay as they are."""
        if transform not in TRANSFORMS:
            raise ValueError(f"transform must be one of {tuple(TRANSFORMS)}, got {transform!r}")
        now = self._settings()
        self._change(now["schema_json"], now["spec_id"] + 1, transform, now["version"] + 1)

    def fields(self) -> DataFrame:
        """The current schema: ``field_id, name, type, required``."""
        return self.facts().select(F.inline("schema"))

    def facts(self) -> DataFrame:
        """One row of metadata; no data file is read."""
        now = self._settings()
        schema = _schema_of(now["schema_json"])
        listed = [
            F.struct(
                F.lit(field_id).alias("field_id"),
                F.lit(field.name).alias("name"),
                F.lit(_fact_type(field)).alias("type"),
                F.lit(not field.nullable).alias("required"),
            )
            for field_id, field in enumerate(schema.fields, start=1)
        ]
        spec = F.struct(
            F.lit(TRANSFORMS[now["transform"]].column).alias("name"),
            F.lit(now["transform"]).alias("transform"),
            F.lit(schema.names.index("event_time") + 1).alias("source_id"),
            F.lit("event_time").alias("source_column"),
        )
        return self.state().select(
            F.lit(self.identifier).alias("table_identifier"),
            F.col("snapshot_id").alias("current_snapshot_id"),
            "snapshot_count",
            F.array(*listed).alias("schema"),
            F.array(spec).alias("partition_spec"),
        )

    def files(self) -> DataFrame:
        """Path, layout and size of each committed data file; only the listing is read."""
        newest = self.resolve()
        if newest is None:
            return self.spark.createDataFrame([], "path string, spec_id int, length bigint")
        listed = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(f"{self.root}/data")
        )
        spec_id = F.regexp_extract("path", r"/spec_id=(\d+)/", 1).cast("int")
        write_id = F.regexp_extract("path", r"/write_id=(\d+)/", 1).cast("bigint")
        committed = [
            (spec_id == piece["spec_id"])
            & write_id.between(piece["first_write"], piece["last_write"])
            for piece in newest["layout"]
        ]
        return listed.where(reduce(or_, committed)).select(
            "path", spec_id.alias("spec_id"), "length"
        )

    # ------------------------------------------------------------------ reads

    def resolve(
        self, as_of_snapshot_id: int | None = None, as_of_timestamp: datetime | None = None
    ):
        """The ledger row of the snapshot a read answers from; None for an empty log."""
        if as_of_snapshot_id is not None and as_of_timestamp is not None:
            raise AsOfConflictError("give at most one of as_of_snapshot_id and as_of_timestamp")
        if as_of_snapshot_id is not None:
            found = self.snapshots().where(F.col("snapshot_id") == as_of_snapshot_id).first()
            if found is None:
                raise SnapshotNotFoundError(f"snapshot_id {as_of_snapshot_id} not found")
            return found
        if as_of_timestamp is not None:
            found = snapshot_at(self.snapshots(), as_of_timestamp).first()
            if found is None:
                moment = to_utc(as_of_timestamp).isoformat()
                raise SnapshotNotFoundError(f"no snapshot at or before {moment}")
            return found
        return self.commits().orderBy(F.col("sequence_number").desc()).limit(1).first()

    def resolve_many(self, moments: DataFrame, moment: str) -> DataFrame:
        """A table of moments with the snapshot each is answered from, see :func:`snapshots_at`."""
        return snapshots_at(self.snapshots(), moments, moment)

    def at(
        self, as_of_snapshot_id: int | None = None, as_of_timestamp: datetime | None = None
    ) -> Snapshot:
        """The snapshot with an id, the newest at or before a time, or the current one.

        A read as of a snapshot has that snapshot's columns, a current read those in force now.
        """
        row = self.resolve(as_of_snapshot_id, as_of_timestamp)
        current = as_of_snapshot_id is None and as_of_timestamp is None
        schema = self.schema() if current else _schema_of(row["schema_json"])
        return Snapshot(self, row, schema, current)

    def scan(
        self,
        as_of_snapshot_id: int | None = None,
        as_of_timestamp: datetime | None = None,
        **filters,
    ) -> DataFrame:
        """Rows of a snapshot, see :meth:`Snapshot.scan`."""
        return self.at(as_of_snapshot_id, as_of_timestamp).scan(**filters)

    def snapshot_id_of(
        self, as_of_snapshot_id: int | None = None, as_of_timestamp: datetime | None = None
    ) -> int | None:
        """Id of the snapshot that answers a read."""
        return self.at(as_of_snapshot_id, as_of_timestamp).snapshot_id

    def create_view(self, name: str, **selector) -> None:
        """Offer a scan to SQL under a name."""
        self.scan(**selector).createOrReplaceTempView(name)

    def _holds(self, folder: str) -> bool:
        """Whether a folder is there; no job runs for it."""
        try:
            self.spark.read.schema("_ int").parquet(f"{self.root}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def _head(self) -> Head:
        """The head as this writer left it, or looked up if it has none or others wrote since."""
        known = self._known
        if known is None or any(
            self._holds(folder)
            for folder in (
                f"ledger/entry={known.entry + 1}",
                f"settings/version={known.settings['version'] + 1}",
                f"expired/run={known.expired_run + 1}",
            )
        ):
            self._known = self._looked_up()
        return self._known

    def _looked_up(self) -> Head:
        committed = F.when(F.col("status") == APPENDED, F.col("sequence_number"))
        carried = F.struct("write_id", "commit_seq", "total_rows", "timestamp_ms", "layout")
        head = self.batch_log().agg(
            F.coalesce(F.max("entry"), F.lit(0)).alias("entry"),
            F.count(committed).alias("n_commits"),
            F.max_by(carried, committed).alias("newest"),
        ).first()
        gone = self.expired().agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.max("run"), F.lit(0)).alias("run")
        ).first()
        newest = head["newest"].asDict() if head["newest"] is not None else None
        return Head(self._settings(), head["entry"], gone["run"], head["n_commits"], gone["n"], newest)

    # ------------------------------------------------------------------ writes

    def ingest(
        self,
        rows: DataFrame,
        batches: DataFrame,
        deduplicated: bool = False,
        stream_batch: str | None = None,
        gate: bool = True,
        cache: bool = True,
    ) -> DataFrame:
        """Gate and append a set of batches; returns their new rows of the batch log.

        ``rows`` are bronze rows whose ``ingest_batch_id`` names their batch, ``batches`` announces
        each batch once as ``batch_id, source_name, ingest_time``. A batch with a FAIL-rule
        violation is not written at all, one without rows is skipped, and every other one becomes a
        snapshot, in order of ingest time and id. A snapshot's time is its batch's ingest time, or
        that of the newest earlier snapshot if a batch comes late: time never runs backwards. Rows
        of no announced batch are left out. Nothing is visible before the batch-log rows are
        written, in one file, at the end.

        ``batches`` may say in ``landed`` that a batch has no document; it is logged as missing.
        ``stream_batch`` names the micro-batch of a stream. A batch that a stream has logged before
        is left alone, also when a lost checkpoint brings it back together with new ones; a missing
        one is not. The rows are read for the report and again for the write; ``cache`` keeps them
        in between, which pays unless they are cheap to compute, as in a backfill from columnar
        files.
        """
        if stream_batch is not None:
            logged = self.batch_log().where(
                F.col("stream_batch").isNotNull() & (F.col("status") != MISSING)
            ).select("batch_id")
            batches = batches.join(logged, "batch_id", "left_anti")
            if batches.isEmpty():
                return self.batch_log().limit(0)
        if not cache:
            return self._ingest(rows, batches, deduplicated, stream_batch, gate)
        rows = rows.persist()
        try:
            return self._ingest(rows, batches, deduplicated, stream_batch, gate)
        finally:
            rows.unpersist()

    def _ingest(self, rows, batches, deduplicated, stream_batch, gate) -> DataFrame:
        head = self._head()
        settings, newest, entry = head.settings, head.newest, head.entry + 1
        schema = _schema_of(settings["schema_json"])
        snapshots_before = head.n_commits - head.n_expired
        write_id = newest["write_id"] + 1 if newest else 1
        last_commit = newest["commit_seq"] if newest else 0
        rows_before = newest["total_rows"] if newest else 0
        time_before = newest["timestamp_ms"] if newest else None

        # Windows without a partition run over one row per announced batch, not over data.
        so_far = Window.orderBy("ingest_time", "batch_id").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        appended = F.col("status") == APPENDED
        judged = (
            self._judge(rows, batches, deduplicated, gate)
            .withColumn("_appended", F.sum(appended.cast("bigint")).over(so_far))
            # Batches are in order of ingest time, so one bound holds for all of them.
            .withColumn("timestamp_ms", F.greatest(F.unix_millis("ingest_time"), F.lit(time_before).cast("bigint")))
            .withColumn("total_rows", rows_before + F.sum("rows_written").over(so_far))
            .withColumn("commit_seq", F.when(appended, last_commit + F.col("_appended")))
            .withColumn("snapshot_count", snapshots_before + F.col("_appended"))
            .withColumn(
                "current_snapshot_id", F.nullif(last_commit + F.col("_appended"), F.lit(0))
            )
            .persist()
        )
        try:
            # A row per batch is computed once for all of this; one row comes back.
            taken = judged.agg(
                F.count_if(appended).alias("n"), F.coalesce(F.sum("rows_written"), F.lit(0)).alias("rows"),
                F.max(F.when(appended, F.col("timestamp_ms"))).alias("timestamp_ms"),
            ).first()
            if taken["n"]:
                accepted = judged.where(appended).select(F.col("batch_id").alias(BATCH_ID), "commit_seq")
                accepted = broadcast_if_few(accepted, taken["n"])
                written = self._write_rows(rows.join(accepted, BATCH_ID), schema, settings, write_id)
                rollups.extend(self.spark, self.root, written, schema, write_id)
            layout = _extended(newest["layout"] if newest else [], settings, write_id)
            ledger = _ledger_rows(judged, settings, _layout_literal(layout), write_id, stream_batch)
            _overwrite(ledger.coalesce(1)).parquet(f"{self.root}/ledger/entry={entry}")
        finally:
            judged.unpersist()
        if taken["n"]:
            newest = {
                "write_id": write_id, "commit_seq": last_commit + taken["n"],
                "total_rows": rows_before + taken["rows"], "timestamp_ms": taken["timestamp_ms"],
                "layout": layout,
            }
        self._known = replace(head, entry=entry, n_commits=head.n_commits + taken["n"], newest=newest)
        return self.batch_log().where(F.col("entry") == entry)

    def _judge(self, rows, batches, deduplicated, gate) -> DataFrame:
        """One row per announced batch: its report and what becomes of it."""
        report = batch_report(rows, (BATCH_ID,), deduplicated).select(
            F.col(BATCH_ID).alias("batch_id"), "n_rows", "n_failures", "n_warnings", "ok",
            "lag_seconds",
        )
        n_rows = F.coalesce("n_rows", F.lit(0))
        passes = F.col("ok") if gate else F.lit(True)
        landed = F.col("landed") if "landed" in batches.columns else F.lit(True)
        status = (
            F.when(~landed, MISSING)
            .when(n_rows == 0, SKIPPED)
            .when(passes, APPENDED)
            .otherwise(ABORTED)
        )
        return batches.join(report, "batch_id", "left").select(
            "batch_id",
            "source_name",
            "ingest_time",
            status.alias("status"),
            n_rows.cast("bigint").alias("rows_in"),
            F.when(status == APPENDED, n_rows).otherwise(0).cast("bigint").alias("rows_written"),
            F.coalesce("n_failures", F.lit(0)).cast("bigint").alias("n_failures"),
            F.coalesce("n_warnings", F.lit(0)).cast("bigint").alias("n_warnings"),
            "lag_seconds",
        )

    def _write_rows(self, rows, schema, settings, write_id) -> DataFrame:
        """Write one write's rows, spread by partition value; returns them as they are in the files.

        The rebalance hint lets Spark split the partition of a crowded day over several tasks and
        join small ones. Files are sorted by place and, within a cell of the globe, by aircraft, so
        that a box and an aircraft both skip pages. A NULL in a required column fails the write, and
        with it the batch.
        """
        transform = TRANSFORMS[settings["transform"]]

        def stored(field: T.StructField) -> Column:
            value = F.col(field.name) if field.name in rows.columns else F.lit(None)
            value = value.cast(field.dataType)
            if not field.nullable:
                value = must_not_be_null(value, field.name)
            return value.alias(field.name)

        partition = transform.of(F.col("event_time")).cast(transform.type_name)
        ready = (
            rows.select(*[stored(field) for field in schema.fields], "commit_seq")
            .withColumn(CELL, cell(F.col("latitude"), F.col("longitude")))
            .withColumn(transform.column, partition)
            .hint("rebalance", transform.column)
            .sortWithinPartitions(transform.column, CELL, "icao24", "event_time")
        )
        folder = f"{self.root}/data/spec_id={settings['spec_id']}/write_id={write_id}"
        writer = _overwrite(ready).partitionBy(transform.column)
        # Callsigns are in no order within a file; a filter of the size that each row group needs
        # tells which groups lack one.
        writer = writer.option("parquet.bloom.filter.enabled#callsign", "true")
        writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(folder)
        stored = _nullable(schema).add("commit_seq", T.LongType())
        return self.spark.read.schema(stored).parquet(folder)

    def append(
        self,
        rows: DataFrame,
        batch_id: str,
        source_name: str,
        ingest_time: datetime,
        cache: bool = True,
    ) -> DataFrame:
        """Append one batch without the gate, under the schema in force; for ``cache`` see
        :meth:`ingest`."""
        announced = self.spark.createDataFrame([(batch_id, source_name, ingest_time)], BATCH_SCHEMA)
        stamped = (
            rows.withColumn("ingest_time", utc_literal(ingest_time))
            .withColumn(BATCH_ID, F.lit(batch_id))
            .withColumn("source_name", F.lit(source_name))
        )
        return self.ingest(stamped, announced, gate=False, cache=cache)

    def expire_snapshots(
        self, retain_last: int, protected: DataFrame | None = None, now: datetime | None = None
    ) -> DataFrame:
        """Drop all but the newest snapshots from the history; returns the expired ids.

        Only ids are recorded. Rows stay, and stay part of every later snapshot.
        """
        gone = expirable(self.snapshots(), retain_last, protected)
        run = self._head().expired_run + 1
        expired_at = utc_literal(now or datetime.now(UTC))
        _overwrite(gone.withColumn("expired_at", expired_at).coalesce(1)).parquet(
            f"{self.root}/expired/run={run}"
        )
        return (
            self.expired()
            .where(F.col("run") == run)
            .orderBy(*newest_first())
            .select("snapshot_id")
        )


class Snapshot:
    """One readable state of a log."""

    def __init__(self, log: StateLog, row, schema: T.StructType, current: bool):
        self.spark, self.root, self.schema = log.spark, log.root, schema
        self.snapshot_id = row["snapshot_id"] if row is not None else None
        self.total_rows = row["total_rows"] if row is not None else 0
        self._layout = row["layout"] if row is not None else []
        self._write_id = row["write_id"] if row is not None else 0
        # All rows of a committed write belong to the current state.
        self._last_commit = None if current else row["commit_seq"]

    def rollup(self, rollup: rollups.Rollup) -> DataFrame:
        return rollups.as_of(self.spark, self.root, rollup, self.schema, self._write_id, self._last_commit)

    def newest(self, icao24: str | None = None) -> DataFrame:
        """The newest row of each aircraft; no data file is read."""
        return newest_per_aircraft(self.rollup(rollups.NEWEST).where(row_filter(icao24=icao24)))

    def interval_counts(
        self,
        interval: str = "hour",
        start: datetime | None = None,
        end: datetime | None = None,
        group_by: str | None = None,
    ) -> DataFrame:
        """Row counts per UTC hour or day; data files are read for parts of an hour only."""
        first, last = rollups.full_hours(start, end)
        whole = F.lit(True)
        if first is not None:
            whole = whole & (F.col("event_hour") >= first)
        if last is not None:
            whole = whole & (F.col("event_hour") <= last)
        hours = self.rollup(rollups.HOURS).where(whole)
        for low, high in rollups.edges(start, end):
            hour = utc_hour_number(F.col("event_time")).alias("event_hour")
            hours = hours.unionByName(
                self.scan(start=low, end=high).select(hour, "origin_country", F.lit(1).cast("bigint").alias("n"))
            )
        return stats_of_hours(hours, interval, group_by)

    def page_window(
        self, offset: int, limit: int, start: datetime | None = None, end: datetime | None = None
    ) -> tuple[datetime, datetime, int] | None:
        """The part of a window that holds the rows from ``offset`` on in order of event time, and how
        many of its rows come before them; None where no row is that far.

        Ranks follow from the counts per hour: one lookup over a row for each hour of the window.
        """
        in_time = Window.orderBy("bucket_start")
        ranked = self.interval_counts("hour", start, end).select(
            "bucket_start", "count", (F.sum("count").over(in_time) - F.col("count")).alias("before"))
        held = ranked.where((F.col("before") < offset + limit) & (F.col("before") + F.col("count") > offset))
        found = held.agg(
            F.unix_micros(F.min("bucket_start")).alias("first"), F.unix_micros(F.max("bucket_start")).alias("last"),
            F.min("before").alias("before"),
        ).first()
        if found["first"] is None:
            return None
        low, high = rollups.hour_bounds(found["first"], found["last"])
        low = low if start is None else max(low, to_utc(start))
        high = high if end is None else min(high, to_utc(end))
        return low, high, offset - found["before"]

    def scan(
        self,
        icao24: str | None = None,
        callsign: str | None = None,
        start: datetime | None = None,
        end: datetime | None = None,
        box: tuple[float, float, float, float] | None = None,
    ) -> DataFrame:
        """Rows that pass the filters, plus ``event_day`` from the partition.

        The filters go to the Parquet scan, and a time window also to the partition column. ``box``
        is least and largest latitude, least and largest longitude; the scan also compares the cells
        that cover it.
        """
        wanted, covered = row_filter(icao24, callsign, start, end), None
        if box is not None:
            wanted, covered = wanted & box_filter(*box), in_ranges(CELL, cell_ranges(*box))
        parts = [self._scan_layout(piece, start, end, covered).where(wanted) for piece in self._layout]
        if not parts:
            with_day = T.StructType(list(self.schema.fields)).add("event_day", T.DateType())
            return self.spark.createDataFrame([], _nullable(with_day))
        return reduce(DataFrame.unionByName, parts)

    def _scan_layout(
        self, piece, start: datetime | None, end: datetime | None, covered: Column | None = None
    ) -> DataFrame:
        """Committed rows of one partition layout. Each layout is a folder read on its own."""
        transform = TRANSFORMS[piece["transform"]]
        stored = _nullable(self.schema).add("commit_seq", T.LongType()).add("write_id", T.LongType())
        if covered is not None:
            stored = stored.add(CELL, T.LongType())
        stored = stored.add(transform.column, SPARK_TYPES[transform.type_name])
        rows = (
            self.spark.read.schema(stored)
            .parquet(f"{self.root}/data/spec_id={piece['spec_id']}")
            .where(F.col("write_id").between(piece["first_write"], piece["last_write"]))
            .where(transform.prune(start, end))
        )
        if covered is not None:
            rows = rows.where(covered)
        if self._last_commit is not None:
            rows = rows.where(F.col("commit_seq") <= self._last_commit)
        if transform.column == "event_day":
            day = F.col("event_day")
        else:
            day = F.date_from_unix_date(F.floor(F.col(transform.column) / 24).cast("int"))
        return rows.select(*self.schema.names, day.alias("event_day"))


def _overwrite(rows: DataFrame):
    """A writer that replaces a whole folder, what a failed write left in other partitions too."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "static")


def _ledger_rows(judged, settings, layout, write_id, stream_batch) -> DataFrame:
    """Judged batches as rows of the batch log; only an appended one describes a snapshot."""
    appended = F.col("status") == APPENDED
    snapshot = {
        "snapshot_id": F.col("commit_seq"),
        "sequence_number": F.col("commit_seq"),
        "timestamp_ms": F.col("timestamp_ms"),
        "operation": F.lit("append"),
        "schema_json": F.lit(settings["schema_json"]),
        "write_id": F.lit(write_id),
        "layout": layout,
        "total_rows": F.col("total_rows"),
        "summary": F.create_map(
            F.lit("added-records"), F.col("rows_written").cast("string"),
            F.lit("total-records"), F.col("total_rows").cast("string"),
        ),
    }
    columns = {name: F.when(appended, value) for name, value in snapshot.items()}
    columns["stream_batch"] = F.lit(stream_batch)
    return judged.select(
        *[
            columns.get(name, F.col(name)).cast(kind).alias(name) for name, kind in LEDGER_FIELDS
        ]
    )


def _schema_of(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def _fact_type(field: T.StructField) -> str:
    name = field.dataType.simpleString()
    return FACT_TYPES.get(name, name)


def _nullable(schema: T.StructType) -> T.StructType:
    """The schema as Parquet files are read: every column may be NULL."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _extended(layout: list, settings, write_id: int) -> list[Row]:
    """The write ids per layout after one more write."""
    pieces = {p["spec_id"]: (p["transform"], p["first_write"]) for p in layout}
    last = {p["spec_id"]: p["last_write"] for p in layout}
    pieces.setdefault(settings["spec_id"], (settings["transform"], write_id))
    last[settings["spec_id"]] = write_id
    return [
        Row(spec_id=spec_id, transform=transform, first_write=first, last_write=last[spec_id])
        for spec_id, (transform, first) in pieces.items()
    ]


def _layout_literal(layout: list[Row]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(piece["spec_id"]).alias("spec_id"),
                F.lit(piece["transform"]).alias("transform"),
                F.lit(piece["first_write"]).cast("bigint").alias("first_write"),
                F.lit(piece["last_write"]).cast("bigint").alias("last_write"),
            )
            for piece in layout
        ]
    )
