import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from rows import T0, announce, at, frame

from statelog import StateLog
from statelog.operators import reads
from statelog.plans import answers, rollups

FEW = 3


@pytest.fixture
def small_nodes(monkeypatch):
    """Nodes of three, so that a few writes fill several levels."""
    monkeypatch.setattr(rollups, "FAN_IN", FEW)


def test_cover_holds_each_write_once(small_nodes):
    for writes in range(0, 200):
        held = []
        for level, node in rollups.cover(writes):
            held += range(node * FEW**level, (node + 1) * FEW**level)
        assert sorted(held) == list(range(writes))
        assert len(held) == len(set(held)) and len(rollups.cover(writes)) <= (FEW - 1) * 6


def test_nodes_are_complete_when_they_are_read(small_nodes):
    there = set()
    for write in range(1, 100):
        there |= {(0, write - 1), *rollups.completed(write)}
        assert set(rollups.cover(write)) <= there


def moments(*text):
    return [None if t is None else datetime.fromisoformat(t).replace(tzinfo=UTC) for t in text]


@pytest.mark.parametrize("start, end, hours, parts", [
    (None, None, (None, None), 0),
    ("2024-01-01 00:00:00", "2024-01-01 01:59:59.999999", (0, 1), 0),
    ("2024-01-01 00:00:00", "2024-01-01 02:00:00", (0, 1), 1),
    ("2024-01-01 00:00:01", "2024-01-01 02:30:00", (1, 1), 2),
    ("2024-01-01 00:10:00", "2024-01-01 00:20:00", (1, -1), 1),
    ("2024-01-01 00:10:00", "2024-01-01 01:10:00", (1, 0), 1),
    ("2024-01-01 05:00:00", "2024-01-01 01:00:00", (5, 0), 0),
])
def test_windows_are_full_hours_and_edges(start, end, hours, parts):
    start, end = moments(start, end)
    base = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp()) // 3600
    found = rollups.full_hours(start, end)
    assert tuple(None if h is None else h - base for h in found) == hours
    assert len(rollups.edges(start, end)) == parts


def filled(spark, log, writes=11):
    """Writes of two commits each, aircraft that come again, late and equal rows, NULL countries."""
    for w in range(writes):
        names = [f"b{w}-{k}" for k in (0, 1)]
        rows = []
        for k, name in enumerate(names):
            for a in range(4):
                moment = (w * 37 + k * 13 + a * 11) % 300
                rows.append(at(moment * 60, icao24=f"a{(a + w) % 6}", ingest_batch_id=name,
                               origin_country=None if a == 3 else f"C{a % 2}", velocity=float(w)))
        log.ingest(frame(spark, rows), announce(spark, *[(n, 2 * w + k) for k, n in enumerate(names)]), gate=False)


def as_set(rows):
    return sorted(map(str, rows.collect()))


def test_results_equal_those_of_all_rows_at_every_snapshot(spark, log, small_nodes):
    filled(spark, log)
    assert log.state().first()["snapshot_count"] == 22
    start, end = T0 + timedelta(minutes=35), T0 + timedelta(hours=3, minutes=10)
    for snapshot_id in [*range(1, 23, 3), 22, None]:
        snapshot, rows = log.at(snapshot_id), log.scan(snapshot_id)
        plain = reads.newest_per_aircraft(rows).select(*snapshot.schema.names)
        assert as_set(snapshot.newest()) == as_set(plain)
        for interval in ("hour", "day"):
            for group in (None, "origin_country"):
                want = reads.stats_per_interval(rows, interval, group_by=group)
                assert snapshot.interval_counts(interval, group_by=group).collect() == want.collect()
        for low, high in ((start, None), (None, end), (start, end), (end, start), (start, start)):
            want = reads.stats_per_interval(rows, "hour", low, high, "origin_country")
            assert snapshot.interval_counts("hour", low, high, "origin_country").collect() == want.collect()


def test_rows_read_grow_with_aircraft_and_not_with_history(spark, log, small_nodes):
    filled(spark, log)
    read = [log.at(s).rollup(rollups.NEWEST).count() for s in (6, 14, 22)]
    held = [log.scan(s).count() for s in (6, 14, 22)]
    assert held[2] == 88 and read[2] <= 24 and read[2] < 2 * read[0] < held[2]


def test_full_hours_read_no_data_file(spark, log):
    filled(spark, log, 2)
    whole = [log.at().newest(), log.at(3).newest(), log.at().interval_counts(),
             log.at(2).interval_counts("day", T0 - timedelta(hours=2), group_by="origin_country")]
    for rows in whole:
        assert rows.inputFiles() and all("/rollups/" in f for f in rows.inputFiles())
    part = log.at().interval_counts("hour", T0 + timedelta(minutes=5))
    assert any("/data/" in f for f in part.inputFiles())


def test_a_repeated_write_replaces_its_node(spark, log, monkeypatch):
    filled(spark, log, 1)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("statelog.plans.log._ledger_rows", broken)
        with pytest.raises(OSError):
            log.ingest(frame(spark, [at(9, icao24="zz", ingest_batch_id="x")]), announce(spark, ("x", 9)), gate=False)
    assert log.at().newest().where("icao24 = 'zz'").count() == 0
    log.ingest(frame(spark, [at(9, icao24="yy", ingest_batch_id="y")]), announce(spark, ("y", 9)), gate=False)
    found = {r["icao24"] for r in log.at().newest().collect()}
    assert "yy" in found and "zz" not in found


def test_another_writer_is_noticed(spark, log):
    filled(spark, log, 1)
    other = StateLog(spark, log.root)
    other.ingest(frame(spark, [at(1, ingest_batch_id="o")]), announce(spark, ("o", 50)), gate=False)
    log.add_column("grade", "string")
    got = log.ingest(
        frame(spark, [at(2, ingest_batch_id="p")]).withColumn("grade", F.lit("A")), announce(spark, ("p", 51)),
        gate=False).first()
    assert (got["commit_seq"], got["write_id"], got["total_rows"], got["snapshot_count"]) == (4, 3, 10, 4)
    assert log.at().newest().where("grade = 'A'").count() == 1
    assert "grade" not in log.at(3).newest().columns


def test_pages_by_rank_equal_pages_of_all_rows(spark, log):
    filled(spark, log, 4)
    rows = log.scan()
    low, high = T0 + timedelta(minutes=40), T0 + timedelta(hours=3, minutes=20)
    for window in ({}, {"start": low}, {"end": high}, {"start": low, "end": high}):
        for limit, offset in ((5, 0), (7, 9), (1, 31), (100, 3), (4, 500)):
            want = reads.flights(rows, limit=limit, offset=offset, **window).collect()
            assert answers.flights(log, limit=limit, offset=offset, **window).rows.collect() == want
    earlier = answers.flights(log, limit=6, offset=5, as_of_snapshot_id=3).rows.collect()
    assert earlier == reads.page(log.scan(3), 6, 5).collect()
    assert answers.flights(log, start=high, end=low).rows.count() == 0


def test_a_deep_page_reads_its_hours_only(spark, log):
    filled(spark, log, 4)
    low, high, skip = log.at().page_window(20, 2)
    assert high - low < timedelta(hours=2) and 0 <= skip < 20
    plan = answers.flights(log, limit=2, offset=20).rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"event_day#\d+ >= ", plan) and re.search(r"event_day#\d+ <= ", plan)
    assert log.at().page_window(10_000, 5) is None


def test_an_empty_log_has_no_results(spark, log):
    assert log.at().newest().count() == 0 and log.at().interval_counts().count() == 0
    assert answers.latest_state(log).rows.count() == 0
