from datetime import UTC, datetime

from pyspark.sql import functions as F

from statelog.functions.clock import epoch_micros, to_utc, utc_bucket, utc_day, utc_hour_number
from statelog.functions.text import clean_callsign
from statelog.operators.bronze import to_bronze
from statelog.schema import BRONZE_COLUMNS, REQUIRED_COLUMNS, bronze_schema

LANDED = datetime(2026, 6, 14, 12, 0, 30, tzinfo=UTC)


def bronze(spark, rows, schema="icao24 string, time_position bigint, last_contact bigint"):
    raw = spark.createDataFrame(rows, schema)
    out = to_bronze(raw, F.lit(LANDED), F.lit("b1"), F.lit("feed"))
    return out, [r.asDict() for r in out.collect()]


def test_schema():
    assert len(BRONZE_COLUMNS) == 21
    assert REQUIRED_COLUMNS == (
        "icao24", "event_time", "last_contact", "on_ground", "ingest_time", "ingest_batch_id",
        "source_name")
    assert [f.nullable for f in bronze_schema().fields].count(False) == 7


def seconds(frame):
    return [r[0] for r in frame.select(F.unix_seconds("event_time")).collect()]


def test_event_time_prefers_the_position_and_counts_zero_as_present(spark):
    out, _ = bronze(spark, [("a", 100, 200), ("b", None, 200), ("c", 0, 200)])
    assert seconds(out) == [100, 200, 0]


def test_unusable_time_keeps_the_row(spark):
    too_late = 253402300800
    out, rows = bronze(spark, [("a", None, None), ("b", too_late, 5), ("c", too_late - 1, 5)])
    assert seconds(out) == [None, None, too_late - 1]
    assert [r[0] for r in out.select("time_position").collect()] == [None, too_late, too_late - 1]


def test_absent_columns_are_null_and_every_row_is_stamped(spark):
    out, (row,) = bronze(spark, [("a", 1, 2)])
    assert out.columns == list(BRONZE_COLUMNS)
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in bronze_schema().fields]
    assert row["velocity"] is None and row["on_ground"] is None
    assert (row["ingest_batch_id"], row["source_name"]) == ("b1", "feed")


def test_callsign(spark):
    samples = ["DLH9LH  ", "   ", None, "", "\tAB 1 ", "　X\x1c\x1f", "A  B"]
    frame = spark.createDataFrame([(s,) for s in samples], "c string")
    got = [r[0] for r in frame.select(clean_callsign(F.col("c"))).collect()]
    assert got == [(s.strip() or None) if s is not None else None for s in samples]


def test_clock_does_not_follow_the_session_zone(spark, zone):
    moments = [0, 1718366400, -1, 1718409599, 951782400 + 86399]
    for name in ("UTC", "America/New_York", "Asia/Kolkata"):
        zone(name)
        frame = spark.createDataFrame([(m,) for m in moments], "s bigint").withColumn(
            "t", F.timestamp_seconds("s"))
        got = frame.select(
            F.unix_date(utc_day(F.col("t"))), utc_hour_number(F.col("t")),
            F.unix_seconds(utc_bucket(F.col("t"), "hour")),
            F.unix_seconds(utc_bucket(F.col("t"), "day")),
        ).collect()
        assert [tuple(r) for r in got] == [
            (m // 86400, m // 3600, m // 3600 * 3600, m // 86400 * 86400) for m in moments]


def test_naive_moments_mean_utc():
    naive = datetime(2026, 6, 14, 12)
    assert to_utc(naive) == naive.replace(tzinfo=UTC)
    assert epoch_micros(naive) == 1781438400 * 10**6


def test_blanks_are_those_of_python(spark):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000]
    frame = spark.createDataFrame([(chr(p) + "A" + chr(p),) for p in points], "c string")
    got = [r[0] for r in frame.select(clean_callsign(F.col("c"))).collect()]
    assert got == [(chr(p) + "A" + chr(p)).strip() for p in points]
