from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from rows import T0, at, frame, row

from statelog.operators import reads


@pytest.fixture(scope="module")
def sample(spark):
    rows = [
        at(i * 1800, icao24=f"00000{i % 4}", callsign=f"CS{i % 3}", origin_country=("DE", "FR", None)[i % 3],
           latitude=float(i * 3 - 45), longitude=float(i * 7 - 100)) for i in range(30)
    ]
    rows += [at(7, icao24="0000ff", latitude=None, longitude=1.0),
             at(8, icao24="0000ff", latitude=1.0, longitude=None)]
    return frame(spark, rows).cache(), rows


def ids(page):
    return [(r["event_time"], r["icao24"]) for r in page.collect()]


def test_filters_against_a_recount(sample):
    table, rows = sample
    start, end = T0 + timedelta(hours=2), T0 + timedelta(hours=9)
    got = reads.flights(table, icao24="000001", callsign="CS1", start=start, end=end, limit=1000)
    want = [r for r in rows if r["icao24"] == "000001" and r["callsign"] == "CS1"
            and start <= r["event_time"] <= end]
    assert got.count() == len(want) > 0
    assert reads.flights(table, limit=1000).count() == len(rows)


def test_window_bounds_are_inclusive_and_naive_means_utc(sample):
    table, _ = sample
    moment = T0 + timedelta(seconds=1800)
    assert reads.flights(table, start=moment, end=moment).count() == 1
    assert reads.flights(table, start=moment.replace(tzinfo=None), end=moment).count() == 1
    assert reads.flights(table, start=moment + timedelta(microseconds=1), end=moment).count() == 0


def test_pages_do_not_overlap_and_cover_all(sample):
    table, rows = sample
    pages = [ids(reads.page(table, 10, offset)) for offset in (0, 10, 20, 30, 40)]
    assert [len(p) for p in pages] == [10, 10, 10, 2, 0]
    joined = [x for p in pages for x in p]
    assert joined == sorted(joined) and len(set(joined)) == len(rows)


@pytest.mark.parametrize("offset", [1, 5, 11, 25, 31, 32])
def test_pages_after_a_row_equal_those_by_offset(sample, offset):
    table, _ = sample
    before = reads.page(table, 1, offset - 1).first()
    after = reads.page(table, 7, after=before)
    assert after.collect() == reads.page(table, 7, offset).collect()


def test_pages_after_a_row_with_crowded_seconds_and_missing_times(spark):
    rows = [at(i // 20, icao24=f"{i:06x}") for i in range(100)]
    rows += [row(icao24=f"n{i}", event_time=None) for i in range(30)]
    table = frame(spark, rows).repartition(5)
    whole = reads.page(table, 1000).collect()
    for place in (0, 19, 20, 41, 98, 99, 100, 115, 129):
        after = reads.page(table, 9, after=whole[place])
        assert after.collect() == whole[place + 1 : place + 10]


def test_box(sample):
    table, rows = sample
    wide = reads.bounding_box(table, -90, 90, -180, 180, limit=1000)
    assert wide.count() == 30
    some = reads.bounding_box(table, -30, 6, -65, 19, limit=1000)
    want = [r for r in rows if r["latitude"] is not None and r["longitude"] is not None
            and -30 <= r["latitude"] <= 6 and -65 <= r["longitude"] <= 19]
    assert some.count() == len(want) > 0
    assert reads.bounding_box(table, 6, -30, -65, 19).count() == 0


def test_latest_state_order_of_ties(spark):
    later = T0 + timedelta(hours=1)
    rows = [
        row(icao24="a", last_contact=10, event_time=T0, callsign="old"),
        row(icao24="a", last_contact=11, event_time=T0, callsign="early", ingest_time=later),
        row(icao24="a", last_contact=11, event_time=later, callsign="first"),
        row(icao24="a", last_contact=11, event_time=later, ingest_time=later, callsign="newest"),
        row(icao24="b", last_contact=None, callsign="no contact"),
        row(icao24="b", last_contact=1, callsign="contact"),
        row(icao24=None, callsign="x"),
    ]
    got = [(r["icao24"], r["callsign"]) for r in reads.latest_state(frame(spark, rows)).collect()]
    assert got == [("a", "newest"), ("b", "contact"), (None, "x")]
    page = reads.latest_state(frame(spark, rows), limit=1, offset=1)
    assert [r["icao24"] for r in page.collect()] == ["b"]
    one = reads.latest_state(frame(spark, rows), icao24="a")
    assert [r["callsign"] for r in one.collect()] == ["newest"]


def test_latest_state_cuts_a_hot_aircraft_before_the_shuffle(sample):
    plan = reads.newest_per_aircraft(sample[0])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_stats(sample):
    table, rows = sample
    for interval in ("hour", "day"):
        for group in (None, "origin_country"):
            got = reads.stats_per_interval(table, interval, group_by=group).collect()
            assert sum(r["count"] for r in got) == len(rows)
            assert got == sorted(
                got, key=lambda r: (r["bucket_start"], r["group"] is None, r["group"] or ""))
    groups = {r["group"] for r in reads.stats_per_interval(table, "day", group_by="origin_country").collect()}
    assert None in groups
    window = reads.stats_per_interval(table, "hour", start=T0, end=T0 + timedelta(minutes=59))
    assert [r["count"] for r in window.collect()] == [4]


def test_source_profile_sample_and_counts(sample):
    table, rows = sample
    (profile,) = reads.source_profile(table).select(
        "source_name", "n", F.unix_seconds("min_event").alias("lo"), F.unix_seconds("max_event").alias("hi")
    ).collect()
    assert (profile["n"], profile["hi"] - profile["lo"]) == (len(rows), 29 * 1800)
    assert reads.row_sample(table).columns == list(reads.SAMPLE_COLUMNS)
    assert reads.row_sample(table).count() == 5
    assert reads.row_count(table).first()[0] == len(rows)
    assert reads.value_count(table, "callsign", "CS1").first()[0] == 10
    assert reads.value_count(table, "no_such_column", "B").first()[0] == 0


def test_limit_clamp():
    assert reads.clamp_limit(None) == 100
    assert reads.clamp_limit(5000) == 1000
    assert reads.clamp_limit(7) == 7
    assert reads.clamp_limit(None, default=5000) == 1000


def test_arguments_are_checked_before_any_plan():
    with pytest.raises(ValueError):
        reads.page(None, limit=0)
    with pytest.raises(ValueError):
        reads.latest_state(None, offset=-1)
    with pytest.raises(ValueError):
        reads.bounding_box(None, -91, 0, 0, 0)
    with pytest.raises(ValueError):
        reads.bounding_box(None, 0, 0, 0, 180.5)
    with pytest.raises(ValueError):
        reads.stats_per_interval(None, "week")
    with pytest.raises(ValueError):
        reads.stats_per_interval(None, "day", group_by="icao24")
    assert datetime(2026, 6, 14, 12) == T0.replace(tzinfo=None)
