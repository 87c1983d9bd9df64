from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from rows import T0, announce, at, frame, row

from statelog import AsOfConflictError, SnapshotNotFoundError, StateLog
from statelog.operators import reads
from statelog.plans import answers
from statelog.plans.log import ABORTED, APPENDED, SKIPPED, expirable, snapshot_at, snapshots_at


def plan_of(frame_):
    return frame_._jdf.queryExecution().executedPlan().toString()


def two_snapshots(spark, log):
    log.append(frame(spark, [at(i, icao24=f"a{i}") for i in range(20)]), "b1", "feed", T0)
    log.append(frame(spark, [at(i, icao24=f"b{i}") for i in range(15)]), "b2", "feed",
               T0 + timedelta(minutes=1))


def test_time_travel(spark, log):
    two_snapshots(spark, log)
    first, second = [r["snapshot_id"] for r in log.history().collect()]
    assert log.scan(as_of_snapshot_id=first).count() == 20
    assert log.scan().count() == log.scan(as_of_snapshot_id=second).count() == 35
    assert log.snapshot_id_of() == second
    for moment, count in ((T0, 20), (T0 + timedelta(seconds=59), 20), (T0 + timedelta(hours=1), 35)):
        assert log.scan(as_of_timestamp=moment).count() == count
    assert log.snapshot_id_of(as_of_timestamp=T0.replace(tzinfo=None)) == first
    assert reads.latest_state(log.scan(as_of_snapshot_id=first), limit=1000).count() == 20


def test_selectors_that_cannot_be_answered(spark, log):
    two_snapshots(spark, log)
    with pytest.raises(AsOfConflictError):
        log.scan(as_of_snapshot_id=1, as_of_timestamp=T0)
    with pytest.raises(SnapshotNotFoundError):
        log.scan(as_of_snapshot_id=987654321)
    with pytest.raises(SnapshotNotFoundError):
        log.scan(as_of_timestamp=datetime(2000, 1, 1, tzinfo=UTC))


def test_an_empty_log(spark, log):
    assert tuple(log.state().first()) == (None, 0)
    assert log.snapshot_id_of() is None
    assert log.scan().count() == 0 and len(log.scan().columns) == 22
    assert log.list_snapshots().count() == 0 and log.files().count() == 0
    with pytest.raises(SnapshotNotFoundError):
        log.scan(as_of_timestamp=T0)


def test_metadata(spark, log):
    two_snapshots(spark, log)
    listed = log.list_snapshots().collect()
    assert [r["operation"] for r in listed] == ["append", "append"]
    assert listed[1]["summary"] == {"added-records": "15", "total-records": "35"}
    facts = log.facts().first()
    assert (facts["current_snapshot_id"], facts["snapshot_count"]) == (listed[1]["snapshot_id"], 2)
    assert len(facts["schema"]) == 21
    assert [tuple(s) for s in facts["partition_spec"]] == [("event_day", "day", 4, "event_time")]
    fields = {r["name"]: (r["type"], r["required"]) for r in log.fields().collect()}
    assert fields["event_time"] == ("timestamptz", True) and fields["squawk"] == ("string", False)


@pytest.mark.parametrize("numbers", [(1, 2), (None, None)])
def test_resolving_a_time(spark, numbers):
    same = 1_700_000_000_000
    times = (same, same) if numbers[0] else (same - 10, same)
    snapshots = spark.createDataFrame(
        [(111, times[0], numbers[0]), (222, times[1], numbers[1])],
        "snapshot_id bigint, timestamp_ms bigint, sequence_number bigint")
    moment = datetime.fromtimestamp(same / 1000, tz=UTC)
    assert snapshot_at(snapshots, moment).first()["snapshot_id"] == 222
    # Cut, not rounded, to the millisecond.
    just_before = moment - timedelta(microseconds=1)
    found = snapshot_at(snapshots, just_before).first()
    assert (found and found["snapshot_id"]) == (None if numbers[0] else 111)


def test_a_missing_sequence_number_loses_a_tie(spark):
    snapshots = spark.createDataFrame(
        [(1, 5, None), (2, 5, 0)], "snapshot_id bigint, timestamp_ms bigint, sequence_number bigint")
    moment = datetime.fromtimestamp(0.005, tz=UTC)
    assert snapshot_at(snapshots, moment).first()["snapshot_id"] == 2


def test_many_moments_equal_one_lookup_each(spark):
    base = 1_700_000_000_000
    times = [base, base, base + 5, base + 3_600_000, base + 3_600_000 * 30, base + 3_600_000 * 30 + 1]
    snapshots = spark.createDataFrame(
        [(100 + n, t, n if n != 2 else None) for n, t in enumerate(times)],
        "snapshot_id bigint, timestamp_ms bigint, sequence_number bigint")
    asked = [base - 1, base, base + 4, base + 5, base + 6, base + 3_599_999, base + 3_600_000,
             base + 3_600_000 * 29, base + 3_600_000 * 30, base + 3_600_000 * 900]
    moments = spark.createDataFrame(
        [(i, datetime.fromtimestamp(t / 1000, tz=UTC), "x") for i, t in enumerate(asked)] + [(99, None, "x")] * 2,
        "id bigint, moment timestamp, timestamp_ms string")
    found = snapshots_at(snapshots, moments, "moment")
    assert found.columns == ["id", "moment", "timestamp_ms", "snapshot_id"]
    got = sorted((r["id"], r["snapshot_id"]) for r in found.collect())
    want = []
    for i, t in enumerate(asked):
        one = snapshot_at(snapshots, datetime.fromtimestamp(t / 1000, tz=UTC)).first()
        want.append((i, one and one["snapshot_id"]))
    assert got == [*want, (99, None), (99, None)]
    assert snapshots_at(snapshots.limit(0), moments, "moment").where("snapshot_id is not null").count() == 0
    assert snapshots_at(snapshots, moments.limit(0), "moment").count() == 0


def test_row_groups_without_a_callsign_are_skipped(spark, log, compiled):
    rows = [at(i % 3000, icao24=f"a{i:05}", callsign=f"CS{i * 7919 % 10007}", ingest_batch_id="b") for i in range(12_000)]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(64 << 10))
    try:
        log.ingest(frame(spark, rows), announce(spark, ("b", 1)), gate=False)
    finally:
        conf.unset("parquet.block.size")
    found = log.scan(callsign="CS7919")
    assert [r["icao24"] for r in found.collect()] == ["a00001", "a10008"]
    nodes, read = [found._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            read += node.metrics().get("numOutputRows").get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert 2 <= read <= 6_000


def five(spark):
    return spark.createDataFrame(
        [(n, 1000 + n // 2, n) for n in range(1, 6)],
        "snapshot_id bigint, timestamp_ms bigint, sequence_number bigint")


def test_expirable(spark):
    def gone(*args):
        return [r["snapshot_id"] for r in expirable(five(spark), *args).collect()]

    assert gone(2) == [3, 2, 1]
    assert gone(5) == gone(9) == []
    assert gone(2, spark.createDataFrame([(2,)], "snapshot_id bigint")) == [3, 1]
    with pytest.raises(ValueError):
        gone(0)


def test_expiry_keeps_rows_and_current_reads(spark, log):
    batches = announce(spark, *[(f"b{n}", n) for n in range(5)])
    log.ingest(frame(spark, [at(n, ingest_batch_id=f"b{n}") for n in range(5)]), batches)
    assert [r[0] for r in log.expire_snapshots(2).collect()] == [3, 2, 1]
    assert [r[0] for r in log.expire_snapshots(2).collect()] == []
    assert tuple(log.state().first()) == (5, 2)
    assert log.scan().count() == 5 and log.scan(as_of_snapshot_id=4).count() == 4
    with pytest.raises(SnapshotNotFoundError):
        log.scan(as_of_snapshot_id=2)
    with pytest.raises(SnapshotNotFoundError):
        log.scan(as_of_timestamp=T0 + timedelta(seconds=1))
    assert [r[0] for r in log.expire_snapshots(1).collect()] == [4]


def test_batches_are_judged_one_by_one(spark, log):
    rows = [
        at(0, ingest_batch_id="good"), at(1, ingest_batch_id="good", velocity=9999.0),
        at(2, ingest_batch_id="bad"), at(3, ingest_batch_id="bad", latitude=999.0),
        at(4, ingest_batch_id="later"), at(5, ingest_batch_id="unannounced"),
    ]
    batches = announce(spark, ("good", 10), ("bad", 20), ("none", 30), ("later", 40))
    got = {r["batch_id"]: r for r in log.ingest(frame(spark, rows), batches).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "good": APPENDED, "bad": ABORTED, "none": SKIPPED, "later": APPENDED}
    assert [(got[b]["rows_in"], got[b]["rows_written"]) for b in ("good", "bad", "none", "later")] == [
        (2, 2), (2, 0), (0, 0), (1, 1)]
    assert (got["good"]["n_warnings"], got["bad"]["n_failures"]) == (1, 1)
    assert [(got[b]["current_snapshot_id"], got[b]["snapshot_count"]) for b in
            ("good", "bad", "none", "later")] == [(1, 1), (1, 1), (1, 1), (2, 2)]
    assert got["bad"]["snapshot_id"] is None and got["later"]["total_rows"] == 3
    assert log.scan().count() == 3 and log.scan(as_of_snapshot_id=1).count() == 2
    assert log.batch_log().count() == 4


def test_an_aborted_ingest_leaves_the_log_unchanged(spark, log):
    two_snapshots(spark, log)
    before = tuple(log.state().first())
    rows = frame(spark, [at(1, icao24=None, ingest_batch_id="bad")])
    assert log.ingest(rows, announce(spark, ("bad", 99))).first()["status"] == ABORTED
    assert tuple(log.state().first()) == before and log.scan().count() == 35


def test_a_null_in_a_required_column_cannot_be_written(spark, log):
    two_snapshots(spark, log)
    with pytest.raises(PySparkException, match="required column on_ground is null"):
        log.append(frame(spark, [row(on_ground=None)]), "b3", "feed", T0 + timedelta(hours=1))
    assert log.scan().count() == 35 and log.state().first()["snapshot_count"] == 2


def test_what_a_failed_write_left_is_never_read(spark, log, monkeypatch):
    two_snapshots(spark, log)

    def crash(*args):
        raise RuntimeError("lost before the batch log")

    import statelog.plans.log as module

    lost = frame(spark, [at(i, icao24="lost") for i in range(4)])
    with monkeypatch.context() as patch:
        patch.setattr(module, "_ledger_rows", crash)
        with pytest.raises(RuntimeError):
            log.append(lost, "b3", "feed", T0 + timedelta(hours=1))
    assert list(Path(log.root).glob("data/spec_id=0/write_id=3/*/*.parquet"))
    assert log.files().where(F.col("path").contains("write_id=3")).count() == 0
    assert log.scan().count() == 35
    # Neither after the layout changed, nor after a rejected batch, nor after the next good one.
    log.repartition_by("hour")
    bad = frame(spark, [at(1, icao24=None, ingest_batch_id="bad")])
    log.ingest(bad, announce(spark, ("bad", 7200)))
    assert log.scan().count() == 35
    log.append(frame(spark, [at(9, icao24="kept")]), "b4", "feed", T0 + timedelta(hours=3))
    assert log.scan().count() == 36
    assert log.scan().where("icao24 = 'lost'").count() == 0


def test_schema_evolution(spark, log):
    log.append(frame(spark, [at(i) for i in range(20)]), "b1", "feed", T0)
    before = log.snapshot_id_of()
    log.add_column("data_quality_grade", "string")
    assert log.scan().columns[-2:] == ["data_quality_grade", "event_day"]
    assert log.scan().where("data_quality_grade is null").count() == 20
    graded = frame(spark, [at(i) for i in range(10)]).withColumn("data_quality_grade", F.lit("B"))
    log.append(graded, "b2", "feed", T0 + timedelta(minutes=1))
    old = log.scan(as_of_snapshot_id=before)
    assert "data_quality_grade" not in old.columns and old.count() == 20
    assert reads.value_count(old, "data_quality_grade", "B").first()[0] == 0
    assert reads.value_count(log.scan(), "data_quality_grade", "B").first()[0] == 10
    log.append(frame(spark, [at(1)]), "b3", "feed", T0 + timedelta(minutes=2))
    assert log.scan().where("data_quality_grade is null").count() == 21
    assert len(log.facts().first()["schema"]) == 22
    with pytest.raises(ValueError):
        log.add_column("data_quality_grade", "string")


def test_partition_evolution(spark, log):
    log.append(frame(spark, [at(i * 7200) for i in range(24)]), "b1", "feed", T0)
    before = {tuple(r)[:2] for r in log.files().collect()}
    log.repartition_by("hour")
    assert {tuple(r)[:2] for r in log.files().collect()} == before
    log.append(frame(spark, [at(3 * 86400 + i * 1800) for i in range(12)]), "b2", "feed",
               T0 + timedelta(days=4))
    after = {tuple(r)[:2] for r in log.files().collect()}
    assert before < after and {s for _, s in before} == {0} and {s for _, s in after - before} == {1}
    assert log.scan().count() == 36
    assert log.scan(as_of_snapshot_id=1).count() == 24
    days = reads.stats_per_interval(log.scan(), "day").collect()
    by_time = reads.stats_per_interval(log.scan().drop("event_day"), "day").collect()
    assert days == by_time and sum(r["count"] for r in days) == 36
    with pytest.raises(ValueError):
        log.repartition_by("week")


def test_filters_reach_the_files(spark, log):
    rows = [at(i * 3600, icao24=f"a{i % 5}") for i in range(96)]
    log.append(frame(spark, rows), "b1", "feed", T0)
    log.repartition_by("hour")
    log.append(frame(spark, rows), "b2", "feed", T0 + timedelta(days=9))
    start, end = T0 + timedelta(days=1), T0 + timedelta(days=2)
    found = log.scan(icao24="a1", start=start, end=end)
    formatted = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "event_day#" in formatted and "event_hour#" in formatted
    partition_filters = [line for line in formatted.splitlines() if "PartitionFilters" in line]
    assert len(partition_filters) == 2
    assert all("write_id" in line for line in partition_filters)
    assert ">= 2026-06-15" in partition_filters[0] and "<= 2026-06-16" in partition_filters[0]
    pushed = [line for line in formatted.splitlines() if "PushedFilters" in line]
    assert all("EqualTo(icao24,a1)" in line and "event_time" in line for line in pushed)
    want = [r for r in rows if r["icao24"] == "a1" and start <= r["event_time"] <= end]
    assert found.count() == 2 * len(want)
    # Daily counts need no column of the files.
    counted = reads.stats_per_interval(log.scan(), "day")
    formatted = spark._jvm.PythonSQLUtils.explainString(counted._jdf.queryExecution(), "formatted")
    assert formatted.count("ReadSchema: struct<>") == 2


def test_window_filter_at_partition_edges(spark, log, zone):
    midnight = datetime(2026, 6, 15, tzinfo=UTC)
    offsets = [int((midnight - T0).total_seconds()) + s for s in (-1, 0, 1)]
    for name in ("America/New_York", "UTC"):
        zone(name)
        own = StateLog(spark, log.root + name.replace("/", "-"))
        own.append(frame(spark, [at(s) for s in offsets]), "b", "feed", T0)
        assert own.scan(start=midnight).count() == 2
        assert own.scan(end=midnight).count() == 2
        assert own.scan(end=midnight - timedelta(seconds=1)).count() == 1
        days = own.scan().select(F.unix_date("event_day")).distinct().collect()
        assert sorted(r[0] for r in days) == [20618, 20619]


def test_a_crowded_day_is_spread_over_tasks_and_kept_whole(spark, log):
    many = spark.range(0, 60000, 1, 8).select(
        F.concat(F.lit("a"), (F.col("id") % 977).cast("string")).alias("icao24"), F.col("id"))
    base = frame(spark, [row()]).drop("icao24")
    crowded = many.join(F.broadcast(base)).withColumn(
        "event_time", F.timestamp_seconds(F.lit(int(T0.timestamp())) + F.col("id") % 3600))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        log.append(crowded, "b1", "feed", T0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert log.scan().count() == 60000
    assert log.files().count() > 1


def test_views_for_sql(spark, log):
    two_snapshots(spark, log)
    log.create_view("sv", as_of_snapshot_id=1)
    assert spark.sql("select count(*) from sv").first()[0] == 20


def test_a_page_after_a_row_reads_from_its_day_on(spark, log):
    log.append(frame(spark, [at(i * 3600, icao24=f"a{i % 5}") for i in range(96)]), "b1", "feed", T0)
    rows = log.scan()
    before = reads.page(rows, 1, 59).first()
    after = reads.page(rows, 10, after=before)
    assert after.collect() == reads.page(rows, 10, 60).collect()
    formatted = spark._jvm.PythonSQLUtils.explainString(after._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in formatted and "event_day#" in formatted.split("PartitionFilters")[1][:300]


def test_time_never_runs_backwards(spark, log):
    hour = timedelta(hours=1)
    log.append(frame(spark, [at(n) for n in range(10)]), "a", "feed", T0 + hour)
    log.append(frame(spark, [at(20 + n) for n in range(5)]), "late", "feed", T0)
    with pytest.raises(SnapshotNotFoundError):
        log.scan(as_of_timestamp=T0 + hour / 2)
    for moment in (T0 + hour, T0 + 2 * hour):
        assert log.scan(as_of_timestamp=moment).count() == log.scan().count() == 15
    log.append(frame(spark, [at(40)]), "c", "feed", T0 + 2 * hour)
    assert [r["snapshot_id"] for r in log.expire_snapshots(2).collect()] == [1]


def test_a_crash_leaves_nothing_under_dynamic_overwrite(spark, log, monkeypatch):
    import statelog.plans.log as module

    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        with monkeypatch.context() as patch:
            patch.setattr(module, "_ledger_rows", lambda *args: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                log.append(frame(spark, [at(n * 86400) for n in range(10)]), "a", "feed", T0)
        log.append(frame(spark, [at(n) for n in range(4)]), "b", "feed", T0, cache=False)
        assert log.scan().count() == log.resolve()["total_rows"] == 4
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_answers_report_their_limit(spark, log):
    two_snapshots(spark, log)
    found = answers.flights(log, limit=500, maximum=7)
    assert (found.limit, found.count()) == (7, 7)
    assert answers.flights(log, limit=3).limit == 3
    record = answers.diagnose_flights(log, sample_limit=500, max_rows=9).first()
    assert (record["requested_limit"], record["returned"], record["rows_examined"]) == (9, 9, 9)


def test_answers_say_which_snapshot_they_are_from(spark, log):
    assert answers.flights(log).snapshot_id is None
    assert answers.flights(log).rows.count() == 0
    two_snapshots(spark, log)
    found = answers.flights(log, icao24="a3", as_of_snapshot_id=1)
    assert (found.snapshot_id, found.rows.count()) == (1, 1)
    assert answers.flights(log, limit=5, offset=30).rows.count() == 5
    assert answers.bounding_box(log, -90, 90, -180, 180, as_of_timestamp=T0).rows.count() == 20
    assert answers.latest_state(log, limit=3).rows.count() == 3
    assert answers.stats_per_interval(log, "day").rows.first()["count"] == 35
    assert answers.stats_per_interval(log, "day", as_of_snapshot_id=1).rows.first()["count"] == 20
    for wrong in (
        lambda: answers.flights(log, limit=0),
        lambda: answers.bounding_box(log, -91, 0, 0, 0),
        lambda: answers.stats_per_interval(log, "week"),
        lambda: answers.latest_state(log, as_of_snapshot_id=1, as_of_timestamp=T0),
    ):
        with pytest.raises(ValueError):
            wrong()
