import math
import random
from datetime import timedelta

import pytest
from rows import T0, at, frame, row

from statelog.operators import diagnosis as d


def findings(spark, *rows):
    found = d.detect_anomalies(frame(spark, list(rows))).orderBy("position").collect()
    return {r["kind"]: r for r in found}


def test_clean_rows_have_no_findings(spark):
    assert findings(spark, row(), at(5)) == {}
    record = d.diagnose(frame(spark, [row()]), 42).first()
    assert record["ok"] is True and record["findings"] == [] and record["proposals"] == []
    assert (record["snapshot_id"], record["rows_examined"]) == (42, 1)


@pytest.mark.parametrize(
    "changes, kind, severity, shown",
    [
        ({"velocity": 2200.0}, "over_speed", "WARN", "2200.0"),
        ({"velocity": math.nan}, "over_speed", "WARN", "NaN"),
        ({"position_source": 9}, "unknown_position_source", "WARN", "9"),
        ({"geo_altitude": 99999.0}, "geo_altitude_out_of_range", "WARN", "99999.0"),
        ({"callsign": "WAYTOOLONG"}, "callsign_length", "WARN", "WAYTOOLONG"),
        ({"latitude": 999.0}, "latitude_out_of_range", "FAIL", "999.0"),
        ({"longitude": 999.0}, "longitude_out_of_range", "FAIL", "999.0"),
        ({"icao24": None}, "null_icao24", "FAIL", None),
        ({"event_time": None}, "null_event_time", "FAIL", None),
        ({"last_contact": None}, "null_last_contact", "FAIL", None),
        ({"on_ground": None}, "null_on_ground", "FAIL", None),
    ],
)
def test_each_kind(spark, changes, kind, severity, shown):
    found = findings(spark, at(1), row(**changes))
    assert list(found) == [kind]
    assert (found[kind]["severity"], found[kind]["count"]) == (severity, 1)
    (example,) = found[kind]["examples"]
    assert example["value"] == shown
    assert example["icao24"] == (None if kind == "null_icao24" else "3c6444")


def test_examples_are_the_first_five_in_page_order(spark):
    rows = [at(100 - i, icao24=f"a{i:02d}", velocity=2000.0 + i) for i in range(20)]
    found = findings(spark, *rows)["over_speed"]
    assert found["count"] == 20
    assert [e["icao24"] for e in found["examples"]] == ["a19", "a18", "a17", "a16", "a15"]


def test_duplicate_surplus(spark):
    rows = [row(), row(), row(), at(5), at(5), row(icao24=None), row(icao24=None)]
    found = findings(spark, *rows)
    assert found["duplicate_state_key"]["count"] == 3
    assert found["duplicate_state_key"]["examples"] == []
    assert d.duplicate_surplus(frame(spark, [at(1)])).first()["surplus"] == 0
    assert d.duplicate_surplus(frame(spark, [])).first()["surplus"] == 0


def test_coverage_gap(spark):
    def of(*ids):
        return frame(spark, [row(icao24=i) for i in ids])

    (gap,) = d.latest_state_gap(of("a"), of("a", "b", "b", None)).collect()
    assert (gap["kind"], gap["count"]) == ("latest_state_gap", 1)
    assert [e["icao24"] for e in gap["examples"]] == ["b"]
    assert d.latest_state_gap(of("a", "b", None), of("b", None)).collect() == []
    (gap,) = d.latest_state_gap(of("x"), of(*"gfedcba")).collect()
    assert gap["count"] == 7 and [e["icao24"] for e in gap["examples"]] == list("abcde")


def test_proposals(spark):
    found = spark.createDataFrame(
        [(6, "null_icao24"), (7, "null_event_time"), (0, "over_speed"), (99, "something new")],
        "position int, kind string")
    got = [r["proposal"] for r in d.propose_remediations(found).orderBy("position").collect()]
    assert [p.split("; not applied): ")[1] for p in got] == [
        d.REMEDIATIONS["over_speed"] + ".", d.REMEDIATIONS["null_required"] + ".",
        d.DEFAULT_REMEDIATION + "."]
    assert all(p.startswith("PROPOSED (requires human approval") for p in got)


def test_diagnosis_record(spark):
    current = frame(spark, [row(), row(velocity=2200.0), at(5, latitude=999.0)])
    gap = d.latest_state_gap(current, frame(spark, [row(icao24="gone")]))
    record = d.diagnose(current, 7, requested_limit=500, extra=[gap]).first()
    assert [f["kind"] for f in record["findings"]] == [
        "over_speed", "latitude_out_of_range", "duplicate_state_key", "latest_state_gap"]
    assert len(record["proposals"]) == 4 and record["ok"] is False
    assert "row limit (500)" in record["limitations"] and "snapshot 7" in record["limitations"]


def test_sample_limit():
    assert d.sample_limit(None, 1000) == 1000
    assert d.sample_limit(0, 1000) == 1000
    assert d.sample_limit(50, 1000) == 50
    assert d.sample_limit(5000, 1000) == 1000


def stays(spark, silence, *rows):
    found = d.presence(frame(spark, list(rows)), silence).collect()
    zero = T0.replace(tzinfo=None)
    minutes = lambda moment: int((moment.replace(tzinfo=None) - zero).total_seconds() // 60)
    return sorted((r["icao24"], minutes(r["first_seen"]), minutes(r["last_seen"]), r["n_rows"]) for r in found)


def test_presence_is_stays_parted_by_silence(spark, zone):
    zone("UTC")
    rows = [at(60 * m, icao24="a") for m in (0, 59, 60, 121, 182, 182)] + [at(60 * m, icao24="b") for m in (5, 125, 126)]
    rows += [at(0, icao24=None), row(icao24="c", event_time=None)]
    assert stays(spark, timedelta(minutes=61), *rows) == [("a", 0, 182, 6), ("b", 5, 5, 1), ("b", 125, 126, 2)]
    # Silence of exactly the given length is no end.
    assert stays(spark, timedelta(minutes=120), *rows)[1:] == [("b", 5, 126, 3)]
    with pytest.raises(ValueError):
        d.presence(frame(spark, []), timedelta(minutes=59))


def test_presence_against_plain_stays(spark, zone):
    zone("UTC")
    pick = random.Random(8)
    minutes = {a: sorted(pick.randrange(6000) for _ in range(60)) for a in "abc"}
    for hours in (1, 2, 5):
        want = []
        for a, times in minutes.items():
            parts = [[times[0]]]
            for m in times[1:]:
                if m - parts[-1][-1] > 60 * hours:
                    parts.append([])
                parts[-1].append(m)
            want += [(a, p[0], p[-1], len(p)) for p in parts]
        rows = [at(60 * m, icao24=a) for a, times in minutes.items() for m in times]
        assert stays(spark, timedelta(hours=hours), *rows) == sorted(want)


def test_aircraft_that_went_silent_are_missing(spark):
    rows = frame(spark, [at(0, icao24="a"), at(7200, icao24="a"), at(0, icao24="gone"), at(4000, icao24="b"), at(10, icao24=None)])
    here = d.still_present(rows, timedelta(hours=1))
    assert sorted(r["icao24"] for r in here.collect()) == ["a", "b"]
    assert [r["icao24"] for r in d.missing_aircraft(here, rows).collect()] == ["gone"]
    assert d.still_present(rows.limit(0), timedelta(hours=1)).count() == 0
