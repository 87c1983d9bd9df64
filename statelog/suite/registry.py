"""The registered queries. Each takes a session and a data folder and returns a DataFrame.

Instants come out as zone-less UTC timestamps, the type the SQL side has.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statelog.operators import diagnosis, quality, reads
from statelog.operators.bronze import to_bronze
from statelog.operators.dedupe import first_per_state_key
from statelog.plans import answers
from statelog.plans.log import StateLog, expirable, snapshot_at
from statelog.schema import BRONZE_COLUMNS
from statelog.sources.payload import RECORD_ORDER, decode_states
from statelog.streaming.ingest import batch_name
from statelog.suite import logs, view

# Arguments of the queries; the SQL side states the same ones.
AIRCRAFT = "000005"
CALLSIGN = "VIE5"
WINDOW_START = datetime(2024, 1, 9, 6, tzinfo=UTC)
WINDOW_END = datetime(2024, 1, 12, 18, 30, tzinfo=UTC)
BOX = {"min_lat": -30.0, "max_lat": 45.5, "min_lon": -100.0, "max_lon": 60.0}
PAGE = {"limit": 200, "offset": 150}
AS_OF_SNAPSHOT = 11
AS_OF_TIME = datetime(2024, 1, 17, 12, tzinfo=UTC)
LAST_DAY = datetime(2024, 1, 30, tzinfo=UTC)
AFTER_ALL = datetime(2024, 6, 1, tzinfo=UTC)
SAMPLE_LIMIT = 500
#: An aircraft that is not heard of for longer is away.
SILENCE = timedelta(hours=18)

BATCH = ("poll_id",)


def _zoneless(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"`{f.name}`")
            for f in rows.schema.fields
        ]
    )


def _bronze_only(rows: DataFrame) -> DataFrame:
    return _zoneless(rows.select(*BRONZE_COLUMNS))


# ------------------------------------------------------------------ payload to bronze


def raw_state_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_states(view.documents(spark, sf_dir))


def bronze_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoneless(view.bronze(spark, sf_dir))


def dedupe_within_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view.records(spark, sf_dir)
    return _zoneless(first_per_state_key(records, ("event_id",), BATCH))


def landed_polls_to_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = decode_states(view.documents(spark, sf_dir))
    first = first_per_state_key(records, RECORD_ORDER, BATCH)
    source, landed = view.provenance("poll_id")
    rows = to_bronze(first, landed, batch_name(source, F.col("poll_id")), source)
    return _zoneless(rows)


# ------------------------------------------------------------------ data quality


def dq_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality.rule_counts(view.bronze(spark, sf_dir), BATCH)
    return counts.withColumnsRenamed({"column": "column_name", "check": "check_name"})


def dq_failure_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = quality.failure_cases(view.bronze(spark, sf_dir), "event_id", BATCH)
    return _shown_cases(cases)


def dq_case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_cases(quality.case_summary(view.bronze(spark, sf_dir), "event_id", BATCH))


def _shown_cases(cases: DataFrame) -> DataFrame:
    """Numbers as numbers, so that their text form does not matter."""
    number = F.col("failure_case").try_cast("double")
    return (
        cases.withColumn("failure_number", number)
        .withColumn("failure_text", F.when(number.isNull(), F.col("failure_case")))
        .drop("failure_case")
        .withColumnsRenamed({"column": "column_name", "check": "check_name", "index": "row_index"})
    )


def dq_batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.batch_report(view.bronze(spark, sf_dir), BATCH)
    return report.select(
        "poll_id", "n_rows", "n_failures", "n_warnings", "has_duplicates", "ok",
        F.when(F.col("ok"), F.col("n_rows")).otherwise(F.lit(0)).alias("rows_written"),
    )


def ingest_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.batch_report(view.bronze(spark, sf_dir), BATCH).select("poll_id", "lag_seconds")


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(logs.batch_log(spark, sf_dir).batch_log())


def _results(ledger: DataFrame) -> DataFrame:
    """Result of each batch, with the snapshot count after it."""
    return _zoneless(
        ledger.select(
            "batch_id", "source_name", "ingest_time", "status", "rows_in", "rows_written",
            "n_failures", "n_warnings", "lag_seconds", "current_snapshot_id", "snapshot_count",
            "snapshot_id", "total_rows",
        )
    )


# ------------------------------------------------------------------ reads of the current table


def flights_by_icao24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(answers.flights(logs.batch_log(spark, sf_dir), icao24=AIRCRAFT).rows)


def flights_by_callsign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.flights(logs.batch_log(spark, sf_dir), callsign=CALLSIGN, limit=5000)
    return _bronze_only(found.rows)


def flights_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(
        logs.batch_log(spark, sf_dir).scan(start=WINDOW_START, end=WINDOW_END)
    )


def flights_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.flights(logs.batch_log(spark, sf_dir), start=WINDOW_START, **PAGE)
    return _bronze_only(found.rows)


def flights_page_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page, from the row before it on instead of by its offset."""
    rows = logs.batch_log(spark, sf_dir).scan(start=WINDOW_START)
    before = reads.page(rows, 1, PAGE["offset"] - 1).first()
    return _bronze_only(reads.page(rows, PAGE["limit"], after=before))


def flights_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.flights(logs.batch_log(spark, sf_dir), limit=300, offset=500)
    return _bronze_only(found.rows)


def flights_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows match and are asked for than a page may have; the answer says what it gave."""
    found = answers.flights(logs.batch_log(spark, sf_dir), start=WINDOW_START, limit=5000)
    return _bronze_only(found.rows).withColumn("page_limit", F.lit(found.limit))


def flights_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.flights(
        logs.batch_log(spark, sf_dir), AIRCRAFT, CALLSIGN, WINDOW_START, LAST_DAY
    )
    return _bronze_only(found.rows)


def bbox_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.batch_log(spark, sf_dir)
    return _bronze_only(answers.bounding_box(log, **BOX, start=WINDOW_START, **PAGE).rows)


def bbox_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(logs.batch_log(spark, sf_dir).scan(box=tuple(BOX.values())))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(logs.batch_log(spark, sf_dir).at().newest())


def latest_state_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.latest_state(logs.batch_log(spark, sf_dir), limit=50, offset=3)
    return _bronze_only(found.rows)


def latest_state_of_aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.latest_state(logs.batch_log(spark, sf_dir), icao24=AIRCRAFT)
    return _bronze_only(found.rows)


def latest_state_ungated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(reads.newest_per_aircraft(view.bronze(spark, sf_dir)))


def stats_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(logs.batch_log(spark, sf_dir), "hour")


def stats_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(logs.batch_log(spark, sf_dir), "day")


def stats_day_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.stats_per_interval(
        logs.batch_log(spark, sf_dir), "day", group_by="origin_country"
    )
    return _counts(found.rows)


def stats_hour_by_country_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.stats_per_interval(
        logs.batch_log(spark, sf_dir), "hour", WINDOW_START, WINDOW_END, "origin_country"
    )
    return _counts(found.rows)


def _stats(log: StateLog, interval: str, **arguments) -> DataFrame:
    return _counts(answers.stats_per_interval(log, interval, **arguments).rows)


def _counts(counts: DataFrame) -> DataFrame:
    return _zoneless(counts.withColumnsRenamed({"group": "grp", "count": "cnt"}))


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoneless(reads.source_profile(logs.batch_log(spark, sf_dir).scan()))


def row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoneless(reads.row_sample(logs.batch_log(spark, sf_dir).scan()))


def snapshot_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.row_count(logs.batch_log(spark, sf_dir).scan())


def sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs.batch_log(spark, sf_dir).create_view("sv")
    return spark.sql(
        "select source_name, on_ground, count(*) as n, max(velocity) as max_velocity "
        "from sv group by source_name, on_ground"
    )


# ------------------------------------------------------------------ snapshots and time travel


def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = logs.batch_log(spark, sf_dir).list_snapshots()
    return _zoneless(
        listed.select(
            "snapshot_id",
            "timestamp",
            "operation",
            F.col("summary")["added-records"].cast("bigint").alias("added_records"),
            F.col("summary")["total-records"].cast("bigint").alias("total_records"),
        )
    )


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.batch_log(spark, sf_dir).history()


def snapshot_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = logs.batch_log(spark, sf_dir).snapshots()
    return snapshot_at(snapshots, AS_OF_TIME).select("snapshot_id", "timestamp_ms")


def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = logs.batch_log(spark, sf_dir).facts()
    return facts.select(
        "table_identifier", "current_snapshot_id", "snapshot_count",
        F.col("partition_spec")[0]["name"].alias("partition_name"),
        F.col("partition_spec")[0]["transform"].alias("partition_transform"),
        F.col("partition_spec")[0]["source_column"].alias("partition_source"),
        F.inline("schema"),
    )


def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.batch_log(spark, sf_dir).state()


def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(
        logs.batch_log(spark, sf_dir).scan(as_of_snapshot_id=AS_OF_SNAPSHOT)
    )


def as_of_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = logs.batch_log(spark, sf_dir).at(as_of_timestamp=AS_OF_TIME)
    answered = F.lit(snapshot.snapshot_id).cast("bigint")
    return reads.row_count(snapshot.scan()).select(answered.alias("snapshot_id"), "n_rows")


def as_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that answered at the time of every event, late polls and all."""
    moments = view.moments(spark, sf_dir)
    found = logs.late_log(spark, sf_dir).resolve_many(moments, "moment")
    return found.select("event_id", "snapshot_id")


def flights_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.flights(
        logs.batch_log(spark, sf_dir),
        start=WINDOW_START, end=LAST_DAY, as_of_timestamp=AS_OF_TIME, **PAGE,
    )
    return _bronze_only(found.rows)


def bbox_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.batch_log(spark, sf_dir)
    return _bronze_only(log.scan(as_of_snapshot_id=AS_OF_SNAPSHOT, box=tuple(BOX.values())))


def latest_state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(logs.batch_log(spark, sf_dir).at(as_of_timestamp=AS_OF_TIME).newest())


def stats_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.batch_log(spark, sf_dir)
    return _stats(log, "day", group_by="origin_country", as_of_snapshot_id=AS_OF_SNAPSHOT)


def expire_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.expired_log(spark, sf_dir)
    gone = log.expired().select("snapshot_id", F.lit(True).alias("_gone"))
    return log.commits().join(gone, "snapshot_id", "left").select(
        "snapshot_id", "timestamp_ms", "rows_written",
        F.coalesce("_gone", F.lit(False)).alias("is_expired"),
    )


def rows_after_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.expired_log(spark, sf_dir)
    return _stats(log, "day")


# ------------------------------------------------------------------ late batches


def as_of_timestamp_late_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as of a time when a third of the polls was still to come, and of one after all."""
    log = logs.late_log(spark, sf_dir)
    parts = []
    for name, moment in (("during", AS_OF_TIME), ("after", AFTER_ALL)):
        snapshot = log.at(as_of_timestamp=moment)
        parts.append(
            reads.row_count(snapshot.scan()).select(
                F.lit(name).alias("read_at"),
                F.lit(snapshot.snapshot_id).cast("bigint").alias("snapshot_id"), "n_rows",
            )
        )
    return parts[0].unionByName(parts[1])


def expire_with_late_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.late_log(spark, sf_dir)
    gone = expirable(log.commits(), logs.RETAINED).select("snapshot_id", F.lit(True).alias("_gone"))
    return log.commits().join(gone, "snapshot_id", "left").select(
        "snapshot_id", "batch_id", "timestamp_ms",
        F.coalesce("_gone", F.lit(False)).alias("is_expired"),
    )


# ------------------------------------------------------------------ evolution


def schema_evolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, before = logs.evolved_log(spark, sf_dir)
    frames = []
    for label, rows in (("before", log.scan(as_of_snapshot_id=before)), ("now", log.scan())):
        for grade in ("A", "B"):
            frames.append(
                reads.value_count(rows, logs.EVOLVED_COLUMN, grade).select(
                    F.lit(label).alias("read_at"),
                    F.lit(grade).alias("grade"),
                    F.lit(logs.EVOLVED_COLUMN in rows.columns).alias("has_column"),
                    "n_rows",
                )
            )
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


def evolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = logs.evolved_log(spark, sf_dir)
    return _zoneless(log.scan().drop("event_day"))


def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = logs.evolved_log(spark, sf_dir)
    value = F.regexp_extract("path", r"/(event_day|event_hour)=([^/]+)/", 2)
    name = F.regexp_extract("path", r"/(event_day|event_hour)=([^/]+)/", 1)
    return log.files().select(
        "spec_id", name.alias("partition_name"), value.alias("partition_value")
    ).distinct()


def evolved_window_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = logs.evolved_log(spark, sf_dir)
    return _stats(log, "hour", start=WINDOW_START, end=LAST_DAY)


# ------------------------------------------------------------------ diagnosis


def anomaly_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis.detect_anomalies(view.bronze(spark, sf_dir))
    return found.select(
        "position", "kind", "severity", F.col("count").alias("n"), "detail",
        F.size("examples").cast("bigint").alias("n_examples"),
    )


def finding_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(diagnosis.finding_examples(view.bronze(spark, sf_dir)))


def _examples(shown: DataFrame) -> DataFrame:
    number = F.col("value").try_cast("double")
    return shown.select(
        "kind", "rank", "icao24", number.alias("value_number"),
        F.when(number.isNull(), F.col("value")).alias("value_text"),
    )


def duplicate_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.duplicate_surplus(view.bronze(spark, sf_dir))


def aircraft_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoneless(diagnosis.presence(logs.batch_log(spark, sf_dir).scan(), SILENCE))


def _present_and_older(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Aircraft that the whole log still hears of, and those of an earlier snapshot."""
    log = logs.batch_log(spark, sf_dir)
    return diagnosis.still_present(log.scan(), SILENCE), log.scan(as_of_timestamp=AS_OF_TIME)


def latest_state_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = diagnosis.latest_state_gap(*_present_and_older(spark, sf_dir))
    return gap.select(
        "kind", "severity", F.col("count").alias("n"),
        F.array_join(F.transform("examples", lambda e: e["icao24"]), ",").alias("first_missing"),
    )


def missing_aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.missing_aircraft(*_present_and_older(spark, sf_dir))


def remediation_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = diagnosis.latest_state_gap(*_present_and_older(spark, sf_dir))
    found = diagnosis.detect_anomalies(view.bronze(spark, sf_dir)).unionByName(gap)
    return diagnosis.propose_remediations(found)


def diagnose_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = logs.batch_log(spark, sf_dir).at()
    return _diagnosis(diagnosis.diagnose(snapshot.scan(), snapshot.snapshot_id))


def diagnose_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosis(
        answers.diagnose_flights(
            logs.batch_log(spark, sf_dir), start=WINDOW_START, sample_limit=SAMPLE_LIMIT,
            as_of_snapshot_id=AS_OF_SNAPSHOT,
        )
    )


def _diagnosis(record: DataFrame) -> DataFrame:
    """One row per finding of a diagnosis record."""
    return record.select(
        "snapshot_id", "rows_examined", "returned", "ok", "limitations",
        F.size("proposals").cast("bigint").alias("n_proposals"), F.explode("findings").alias("f"),
    ).select(
        "snapshot_id", "rows_examined", "returned", "ok", "limitations", "n_proposals", "f.kind",
        "f.severity", F.col("f.count").alias("n"),
    )


# ------------------------------------------------------------------ stream


def stream_batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(logs.stream_log(spark, sf_dir).batch_log())


def stream_two_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds that use the same poll numbers."""
    ledger = logs.two_feed_log(spark, sf_dir).batch_log()
    return ledger.select("batch_id", "source_name", "status", "rows_written", "snapshot_id")


def stream_many_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll an hour, all of them in one micro-batch."""
    ledger = logs.hourly_log(spark, sf_dir).batch_log()
    return ledger.select("batch_id", "status", "rows_in", "rows_written", "snapshot_id")


def stream_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(logs.stream_log(spark, sf_dir).scan())


def stream_interval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(logs.stream_log(spark, sf_dir), "hour")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of event time, kept by a stream to which some hours came late."""
    return _counts(logs.window_counts(spark, sf_dir))


def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_only(logs.stream_log(spark, sf_dir).at().newest())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        raw_state_decode,
        bronze_projection,
        dedupe_within_batch,
        landed_polls_to_bronze,
        dq_rule_counts,
        dq_failure_cases,
        dq_case_summary,
        dq_batch_gate,
        ingest_lag,
        batch_results,
        flights_by_icao24,
        flights_by_callsign,
        flights_time_window,
        flights_page,
        flights_page_by_day,
        flights_deep_page,
        flights_clamped,
        flights_all_filters,
        bbox_page,
        bbox_all,
        latest_state,
        latest_state_page,
        latest_state_of_aircraft,
        latest_state_ungated,
        stats_hour,
        stats_day,
        stats_day_by_country,
        stats_hour_by_country_in_window,
        source_profile,
        row_sample,
        snapshot_row_count,
        sql_view,
        snapshot_list,
        snapshot_history,
        snapshot_resolve,
        snapshot_state,
        table_facts,
        as_of_snapshot,
        as_of_timestamp,
        as_of_many,
        flights_as_of,
        bbox_as_of,
        latest_state_as_of,
        stats_as_of,
        expire_snapshots,
        rows_after_expiry,
        as_of_timestamp_late_batch,
        expire_with_late_batch,
        schema_evolution_counts,
        evolved_rows,
        partition_layout,
        evolved_window_read,
        anomaly_findings,
        finding_examples,
        duplicate_surplus,
        aircraft_presence,
        latest_state_gap,
        missing_aircraft,
        remediation_proposals,
        diagnose_snapshot,
        diagnose_sample,
        stream_batch_log,
        stream_two_feeds,
        stream_many_polls,
        stream_bronze,
        stream_interval_counts,
        stream_window_counts,
        stream_latest_state,
    )
}
