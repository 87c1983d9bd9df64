import math

import pytest
from rows import EPOCH0, T0, at, frame, row

from statelog.functions.rules import ROW_RULES, diagnosis_rules
from statelog.operators.quality import batch_report, case_summary, failure_cases, rule_counts


def report(spark, rows, **kwargs):
    return {r["ingest_batch_id"]: r for r in batch_report(frame(spark, rows), **kwargs).collect()}


def cases(spark, *rows):
    indexed = frame(spark, [dict(r, n=i) for i, r in enumerate(rows)], extra=("n",))
    found = failure_cases(indexed, "n").orderBy("severity", "position", "index").collect()
    return [(r["severity"], r["column"], r["failure_case"], r["index"]) for r in found]


def test_a_clean_row_passes(spark):
    got = report(spark, [row()])["b1"]
    assert (got["n_rows"], got["n_failures"], got["n_warnings"], got["ok"]) == (1, 0, 0, True)
    assert cases(spark, row()) == []


@pytest.mark.parametrize(
    "changes, severity, column, shown",
    [
        ({"icao24": None}, "FAIL", "icao24", None),
        ({"event_time": None}, "FAIL", "event_time", None),
        ({"last_contact": None}, "FAIL", "last_contact", None),
        ({"on_ground": None}, "FAIL", "on_ground", None),
        ({"ingest_time": None}, "FAIL", "ingest_time", None),
        ({"ingest_batch_id": None}, "FAIL", "ingest_batch_id", None),
        ({"source_name": None}, "FAIL", "source_name", None),
        ({"latitude": 90.01}, "FAIL", "latitude", "90.01"),
        ({"longitude": -180.5}, "FAIL", "longitude", "-180.5"),
        ({"velocity": 2200.0}, "WARN", "velocity", "2200.0"),
        ({"velocity": -0.5}, "WARN", "velocity", "-0.5"),
        ({"geo_altitude": 80000.5}, "WARN", "geo_altitude", "80000.5"),
        ({"position_source": 9}, "WARN", "position_source", "9"),
        ({"callsign": "NINECHARS"}, "WARN", "callsign", "NINECHARS"),
    ],
)
def test_one_broken_field(spark, changes, severity, column, shown):
    assert cases(spark, row(**changes)) == [(severity, column, shown, 0)]
    (got,) = report(spark, [row(**changes)]).values()
    assert got["ok"] is (severity == "WARN")
    assert (got["n_failures"], got["n_warnings"]) == ((1, 0) if severity == "FAIL" else (0, 1))


def test_bounds_nulls_and_nan_are_fine(spark):
    edges = [
        row(latitude=90.0, longitude=180.0, velocity=0.0, geo_altitude=-1000.0, callsign="A"),
        at(1, latitude=-90.0, longitude=-180.0, velocity=1500.0, geo_altitude=80000.0,
           callsign="EIGHTLTR", position_source=3),
        at(2, latitude=None, longitude=None, velocity=None, geo_altitude=None, callsign=None,
           position_source=None),
        at(3, latitude=math.nan, longitude=math.nan, velocity=math.nan, geo_altitude=math.nan),
    ]
    assert cases(spark, *edges) == []


def test_duplicates_are_one_warning_per_batch(spark):
    rows = [row(), row(), row(), at(5), row(ingest_batch_id="b2"), at(5, ingest_batch_id="b2")]
    got = report(spark, rows)
    assert (got["b1"]["n_warnings"], got["b1"]["has_duplicates"], got["b1"]["ok"]) == (1, True, True)
    assert (got["b2"]["n_warnings"], got["b2"]["has_duplicates"]) == (0, False)
    assert cases(spark, row(), row()) == [("WARN", None, "false", None)]


def test_null_keys_equal_each_other_also_after_deduplication(spark):
    rows = [row(icao24=None), row(icao24=None), row()]
    for flag in (False, True):
        assert report(spark, rows, deduplicated=flag)["b1"]["has_duplicates"] is True
    assert report(spark, [row(icao24=None), row()], deduplicated=True)["b1"]["has_duplicates"] is False


def test_all_violations_are_counted(spark):
    rows = [row(icao24=None, latitude=999.0, longitude=999.0, velocity=2200.0), row(velocity=2200.0)]
    (got,) = report(spark, rows).values()
    assert (got["n_failures"], got["n_warnings"], got["ok"]) == (3, 2, False)
    counts = {(r["severity"], r["column"]): r["n_violations"]
              for r in rule_counts(frame(spark, rows)).collect()}
    assert counts[("WARN", "velocity")] == 2 and counts[("FAIL", "latitude")] == 1
    assert counts[("WARN", None)] == 0
    assert len(counts) == len(ROW_RULES) + 1


def test_summary_shows_ten_and_counts_the_rest(spark):
    rows = [at(i, velocity=2000.0 + i, n=i) for i in range(13)] + [at(50, icao24=None, n=50)]
    got = case_summary(frame(spark, rows, extra=("n",)), "n").orderBy("severity", "rank").collect()
    fails, warns = [r for r in got if r["severity"] == "FAIL"], [r for r in got if r["severity"] == "WARN"]
    assert [(r["column"], r["n_cases"], r["n_more"]) for r in fails] == [("icao24", 1, 0)]
    assert [r["index"] for r in warns] == list(range(10))
    assert {(r["n_cases"], r["n_more"]) for r in warns} == {(13, 3)}


def test_lag_needs_every_contact(spark):
    rows = [row(last_contact=EPOCH0 + 21, ingest_time=T0.replace(second=30)),
            row(last_contact=EPOCH0 + 25, ingest_time=T0.replace(second=30))]
    assert report(spark, rows)["b1"]["lag_seconds"] == 5.0
    assert report(spark, [*rows, row(last_contact=None)])["b1"]["lag_seconds"] is None


def test_gate_and_diagnosis_share_their_thresholds():
    assert {r.kind for r in diagnosis_rules()} == {r.kind for r in ROW_RULES if r.kind}
    assert [r.kind for r in diagnosis_rules()][:2] == ["over_speed", "unknown_position_source"]
