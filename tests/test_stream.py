import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from rows import T0

from statelog.operators import reads
from statelog.plans.log import ABORTED, APPENDED, MISSING, SKIPPED
from statelog.plans.scratch import new_folder
from statelog.streaming.ingest import start_ingest_stream


class Feed:
    """Lands polls and runs the stream over what is new."""

    def __init__(self, spark, log):
        self.spark, self.log, self.folder = spark, log, new_folder(spark, "feed")

    def land(self, poll_id, *documents, announce=True, source="feed", folder=None):
        lines = self.spark.createDataFrame(
            [(json.dumps(d) if isinstance(d, dict) else d,) for d in documents], "value string")
        lines.write.mode("append").text(
            f"{self.folder}/landing/source_name={source}/poll_id={folder or poll_id}")
        if announce:
            self.announce(poll_id, source)

    def announce(self, poll_id, source="feed"):
        arrived = self.spark.createDataFrame(
            [(poll_id, source, T0 + timedelta(seconds=poll_id))],
            "poll_id bigint, source_name string, ingest_time timestamp")
        arrived.coalesce(1).write.mode("append").json(f"{self.folder}/arrivals")

    def run(self, checkpoint="checkpoint", **options):
        query = start_ingest_stream(
            self.spark, f"{self.folder}/arrivals", f"{self.folder}/landing", self.log,
            f"{self.folder}/{checkpoint}", **options)
        query.awaitTermination(120)
        assert query.exception() is None
        return {r["batch_id"]: r for r in self.log.batch_log().collect()}


@pytest.fixture
def feed(spark, log):
    return Feed(spark, log)


def state(icao24, contact, callsign="CS1", **changes):
    values = {"latitude": 50.0, "on_ground": False, **changes}
    base = int(T0.timestamp())
    return [icao24, callsign, "DE", base + contact, base + contact, 8.5, values["latitude"], 1.0,
            values["on_ground"], 100.0, 0.0, 0.0, None, 1.0, "1000", False, 0, 1]


def test_each_poll_becomes_a_snapshot(feed, log):
    for poll in range(3):
        rows = [state(f"00000{a}", poll * 60) for a in range(3)]
        feed.land(poll, {"states": rows + [state("000000", poll * 60, "DUP")]})
    got = feed.run()
    assert [got[f"feed/poll-{p}"]["status"] for p in range(3)] == [APPENDED] * 3
    assert [got[f"feed/poll-{p}"]["rows_written"] for p in range(3)] == [3, 3, 3]
    assert [got[f"feed/poll-{p}"]["snapshot_count"] for p in range(3)] == [1, 2, 3]
    assert log.scan().where("callsign = 'DUP'").count() == 0
    assert reads.latest_state(log.scan()).count() == 3
    assert got["feed/poll-2"]["lag_seconds"] == 2.0 - 120


def test_empty_polls_make_no_snapshot(feed, log):
    feed.land(0, {"states": None})
    feed.land(1, {"time": 5})
    feed.land(2, {"states": []})
    got = feed.run()
    assert [got[f"feed/poll-{p}"]["status"] for p in range(3)] == [SKIPPED] * 3
    assert log.snapshot_id_of() is None


def test_a_rejected_or_unreadable_poll_does_not_stop_the_stream(feed, log):
    feed.land(0, {"states": [state("a", 1), state("b", 1, latitude=999.0)]})
    feed.land(1, '{"states": [["a", ')
    feed.land(2, {"states": [state("c", 1, on_ground=None)]})
    feed.land(3, {"states": [state("d", 1)]})
    got = feed.run()
    assert [got[f"feed/poll-{p}"]["status"] for p in range(4)] == [ABORTED, ABORTED, ABORTED, APPENDED]
    assert got["feed/poll-0"]["n_failures"] == 1 and got["feed/poll-0"]["rows_written"] == 0
    assert [r["icao24"] for r in log.scan().collect()] == ["d"]


def test_the_same_key_may_recur_in_a_later_poll(feed, log):
    feed.land(0, {"states": [state("a", 1)]})
    feed.land(1, {"states": [state("a", 1)]})
    feed.run()
    assert log.scan().count() == 2


def test_restart_goes_on_and_replay_changes_nothing(feed, log):
    feed.land(0, {"states": [state("a", 1)]})
    feed.run()
    feed.land(1, {"states": [state("a", 2)]})
    feed.run()
    before = sorted(map(tuple, log.scan().select("icao24", "last_contact").collect()))
    assert len(before) == 2 and log.state().first()["snapshot_count"] == 2
    # A new checkpoint brings every poll back, in one micro-batch with a new one.
    feed.land(2, {"states": [state("a", 3)]})
    feed.run(checkpoint="lost")
    after = sorted(map(tuple, log.scan().select("icao24", "last_contact").collect()))
    assert after[:2] == before and len(after) == 3
    assert log.batch_log().count() == 3
    feed.run(checkpoint="lost again")
    assert log.scan().count() == 3 and log.batch_log().count() == 3


def test_a_crash_before_the_batch_log_is_made_good_by_the_replay(feed, log, monkeypatch):
    import statelog.plans.log as module

    feed.land(0, {"states": [state("a", 1), state("b", 1)]})

    def crash(*args):
        raise RuntimeError("lost before the batch log")

    with monkeypatch.context() as patch:
        patch.setattr(module, "_ledger_rows", crash)
        with pytest.raises(Exception, match="lost before the batch log"):
            feed.run()
    assert log.scan().count() == 0
    got = feed.run()
    assert got["feed/poll-0"]["status"] == APPENDED and log.scan().count() == 2


def test_only_announced_polls_are_read(feed, log):
    feed.land(1, {"states": [state("unannounced", 1)]}, announce=False)
    for poll in (0, 2):
        feed.land(poll, {"states": [state(f"a{poll}", 1)]})
    feed.run()
    assert sorted(r["icao24"] for r in log.scan().collect()) == ["a0", "a2"]


def test_padded_numbers_and_two_feeds(feed, log):
    feed.land(7, {"states": [state("a", 1)]}, folder="007")
    feed.land(7, {"states": [state("b", 1), state("c", 1)]}, source="other")
    got = feed.run()
    assert got["feed/poll-7"]["status"] == got["other/poll-7"]["status"] == APPENDED
    assert {(r["icao24"], r["source_name"]) for r in log.scan().collect()} == {
        ("a", "feed"), ("b", "other"), ("c", "other")}
    # The same number of a third feed comes later.
    feed.land(7, {"states": [state("d", 1)]}, source="third")
    assert feed.run()["third/poll-7"]["status"] == APPENDED and log.scan().count() == 4


def test_a_poll_without_documents_is_reported_and_taken_later(feed, log):
    feed.announce(0)
    assert feed.run()["feed/poll-0"]["status"] == MISSING
    feed.land(0, {"states": [state("a", 1)]})
    feed.run()
    assert [r["icao24"] for r in log.scan().collect()] == ["a"]
    statuses = [r["status"] for r in log.batch_log().orderBy("entry").collect()]
    assert statuses == [MISSING, APPENDED]


def test_polls_per_trigger_does_not_change_the_rows(spark, feed, log):
    from statelog import StateLog

    for poll in range(5):
        feed.land(poll, {"seq": 1, "states": [state("a", poll)]}, {"seq": 0, "states": [
            state("a", poll, "FIRST"), state(f"b{poll}", 1)]})
    feed.run(polls_per_trigger=2)
    assert log.batch_log().select("stream_batch").distinct().count() == 3
    whole = StateLog(spark, log.root + "-whole")
    feed.log = whole
    feed.run(checkpoint="whole")
    assert whole.batch_log().select("stream_batch").distinct().count() == 1
    columns = ["icao24", "callsign", "last_contact", "ingest_batch_id"]
    rows = [sorted(map(tuple, x.scan().select(*columns).collect())) for x in (log, whole)]
    assert rows[0] == rows[1] and len(rows[0]) == 10
    assert log.scan().where("icao24 = 'a' and callsign = 'FIRST'").count() == 5


def test_a_continuous_query_takes_polls_as_they_come(feed, log):
    feed.land(0, {"states": [state("a", 1)]})
    query = start_ingest_stream(
        feed.spark, f"{feed.folder}/arrivals", f"{feed.folder}/landing", log,
        f"{feed.folder}/checkpoint", interval="1 second")
    try:
        query.processAllAvailable()
        feed.land(1, {"states": [state("a", 2)]})
        query.processAllAvailable()
    finally:
        query.stop()
    assert log.state().first()["snapshot_count"] == 2
    assert log.scan().agg(F.max("last_contact")).first()[0] == int(T0.timestamp()) + 2


def test_a_crowded_poll_is_whole(spark, feed, log):
    """One poll and one key hold most rows; nothing is lost and the key is cut to one row."""
    for part in range(4):
        rows = [state("hot" if n % 3 == 0 else f"a{part}-{n}", 1, f"C{n}") for n in range(900)]
        feed.land(0, {"seq": part, "states": rows}, announce=part == 3)
    feed.land(1, {"states": [state("b", 1)]})
    got = feed.run()
    assert got["feed/poll-0"]["status"] == APPENDED
    assert got["feed/poll-0"]["rows_written"] == 1 + 4 * 600
    assert [r["callsign"] for r in log.scan().where("icao24 = 'hot'").collect()] == ["C0"]
