import json

from pyspark.sql import functions as F

from statelog.plans.scratch import new_folder
from statelog.sources.payload import decode_states, read_landed

FULL = ["3c6444", "DLH9LH  ", "Germany", 1718366400, 1718366401, 8.5, 50.0, 10000.0, False, 230.5,
        90.0, 0.0, [1, 2], 10100.0, "1000", False, 0, 1]


def decode(spark, *documents):
    lines = spark.createDataFrame([(d,) for d in documents], "value string")
    return [r.asDict() for r in decode_states(lines).orderBy("seq", "pos").collect()]


def test_eighteen_positions(spark):
    (record,) = decode(spark, json.dumps({"time": 1, "states": [FULL]}))
    assert "sensors" not in record
    assert (record["icao24"], record["callsign"]) == ("3c6444", "DLH9LH  ")
    assert (record["time_position"], record["last_contact"]) == (1718366400, 1718366401)
    assert record["geo_altitude"] == 10100.0 and record["squawk"] == "1000"
    assert record["on_ground"] is False and record["spi"] is False
    assert (record["position_source"], record["category"]) == (0, 1)


def test_missing_trailing_positions_are_null(spark):
    short = FULL[:12] + [None] + FULL[13:17]
    (record,) = decode(spark, json.dumps({"states": [short]}))
    assert record["category"] is None and record["position_source"] == 0
    (record,) = decode(spark, json.dumps({"states": [["abc"]]}))
    assert record["icao24"] == "abc"
    assert all(v is None for k, v in record.items() if k not in ("icao24", "seq", "pos"))


def test_no_states_no_records(spark):
    assert decode(spark, '{"time": 1, "states": null}', '{"time": 1}', '{"states": []}', "  ") == []


def test_order_is_document_then_position(spark):
    docs = [{"seq": 1, "states": [["c"]]}, {"seq": 0, "states": [["a"], ["b"]]}]
    records = decode(spark, *[json.dumps(d) for d in docs])
    assert [(r["icao24"], r["seq"], r["pos"]) for r in records] == [
        ("a", 0, 0), ("b", 0, 1), ("c", 1, 0)]


def test_numbers_of_any_form_and_unreadable_values(spark):
    text = '{"states": [["x", null, null, 1.9, "17e2", "8.5", "n/a", 1e2, "true", NaN]]}'
    good = '{"states": [["x", null, null, 1.9, "17e2", "8.5", "n/a", 1e2, "true"]]}'
    (record,) = decode(spark, good)
    assert (record["time_position"], record["last_contact"]) == (1, 1700)
    assert (record["longitude"], record["latitude"], record["baro_altitude"]) == (8.5, None, 100.0)
    assert record["on_ground"] is True
    assert len(decode(spark, text)) == 1


def test_an_unreadable_document_is_one_record_of_nulls(spark):
    records = decode(spark, '{"states": [["a"', '{"seq": 3, "states": [["b"]]}')
    assert [r["icao24"] for r in records] == [None, "b"]
    assert all(v is None for k, v in records[0].items() if k not in ("seq", "pos"))


def test_landed_folder_has_the_poll_and_may_hold_multi_line_documents(spark):
    folder = new_folder(spark, "landing")
    lines = spark.createDataFrame(
        [("feed", 7, json.dumps({"states": [FULL]}, indent=1))],
        "source_name string, poll_id bigint, value string"
    )
    assert read_landed(spark, folder).count() == 0
    lines.write.partitionBy("source_name", "poll_id").text(folder)
    whole = decode_states(read_landed(spark, folder, whole_files=True))
    assert [(r["poll_id"], r["icao24"]) for r in whole.collect()] == [(7, "3c6444")]
    assert read_landed(spark, folder).where(F.col("poll_id") == 8).count() == 0
