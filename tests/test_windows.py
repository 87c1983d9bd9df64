import json
from datetime import timedelta

import pytest
from rows import EPOCH0, T0

from statelog.plans.scratch import new_folder
from statelog.streaming import windows


class Landing:
    def __init__(self, spark):
        self.spark, self.folder = spark, new_folder(spark, "windows")
        self.polls = 0

    def land(self, *minutes, country="DE"):
        """One poll of states observed some minutes after the first moment."""
        states = [
            [f"a{i}", "CS", country, None if m is None else EPOCH0 + 60 * m, None, *[None] * 13]
            for i, m in enumerate(minutes)]
        line = self.spark.createDataFrame([(json.dumps({"states": states}),)], "value string")
        line.coalesce(1).write.mode("append").text(f"{self.folder}/landing/source_name=feed/poll_id={self.polls}")
        self.polls += 1

    def run(self, delay="2 hours", **options):
        query = windows.start_window_counts(
            self.spark, f"{self.folder}/landing", f"{self.folder}/counts", f"{self.folder}/checkpoint",
            delay=delay, **options)
        query.awaitTermination(120)
        assert query.exception() is None
        rows = windows.read_window_counts(self.spark, f"{self.folder}/counts").collect()
        return {((r.bucket_start - T0.replace(tzinfo=None)) // timedelta(hours=1), r.group): r["count"] for r in rows}


@pytest.fixture
def landing(spark, zone):
    zone("UTC")
    return Landing(spark)


def test_late_rows_within_the_delay_count_and_later_ones_do_not(landing):
    landing.land(0, 10, 70)
    landing.land(190)
    assert landing.run() == {(0, None): 2, (1, None): 1, (3, None): 1}
    # The newest event was at minute 190, so the watermark stands at minute 70.
    landing.land(80, 195)
    assert landing.run() == {(0, None): 2, (1, None): 2, (3, None): 2}
    # The window of the first hour ended before the watermark.
    landing.land(20)
    assert landing.run() == {(0, None): 2, (1, None): 2, (3, None): 2}


def test_groups_rows_without_a_time_and_days(landing):
    landing.land(0, None, 5)
    landing.land(7, country="FR")
    landing.land(9, country=None)
    got = landing.run(group_by="origin_country")
    assert got == {(0, "DE"): 2, (0, "FR"): 1, (0, None): 1}
    days = windows.start_window_counts(
        landing.spark, f"{landing.folder}/landing", f"{landing.folder}/days", f"{landing.folder}/days-at", "day")
    days.awaitTermination(120)
    rows = windows.read_window_counts(landing.spark, f"{landing.folder}/days").collect()
    assert [(r.bucket_start.hour, r["count"]) for r in rows] == [(0, 4)]


def test_a_replayed_batch_changes_nothing(landing):
    landing.land(0, 1)
    first = landing.run()
    again = landing.spark.read.schema(windows.COUNT_SCHEMA).parquet(f"{landing.folder}/counts/batch-0")
    rows = landing.spark.createDataFrame(again.collect(), again.schema)
    rows.write.mode("overwrite").parquet(f"{landing.folder}/counts/batch-0")
    assert landing.run() == first


def test_unknown_intervals_are_refused(spark):
    with pytest.raises(ValueError):
        windows.window_counts(spark.createDataFrame([], "event_time timestamp"), "week")
