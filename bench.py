"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Building the log the reads
use and ingesting every poll as a stream, ``build_log`` and ``stream``, run once to warm up and once
for the time; each writes a log of its own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from statelog.plans import rollups  # noqa: E402
from statelog.suite import logs, view  # noqa: E402
from statelog.suite.registry import QUERIES  # noqa: E402

HEADLINE = (
    "raw_state_decode",
    "bronze_projection",
    "dedupe_within_batch",
    "dq_rule_counts",
    "dq_batch_gate",
    "flights_by_icao24",
    "flights_page",
    "bbox_page",
    "latest_state",
    "latest_state_as_of",
    "stats_hour",
    "stats_day",
    "stats_day_by_country",
    "source_profile",
    "as_of_timestamp",
    "anomaly_findings",
    "duplicate_surplus",
    "missing_aircraft",
    "stream_interval_counts",
    "flights_deep_page",
    "aircraft_presence",
    "as_of_many",
)
RUNS = 3


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("statelog-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    input_rows = view.records(spark, sf_dir).count()
    seconds = {}
    for name, build in (("build_log", logs.build_batch_log), ("stream", logs.build_stream_log)):
        build(spark, sf_dir)
        seconds[name] = timed(lambda: build(spark, sf_dir))
    for name in HEADLINE:
        def run(query=QUERIES[name]):
            # Every column is computed, and no row comes to the driver.
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = statistics.median(timed(run) for _ in range(RUNS))
    snapshot = logs.batch_log(spark, sf_dir).at()
    # What the latest state and the interval counts read, beside all rows of the log.
    rows_read = {
        "latest_state": snapshot.rollup(rollups.NEWEST).count(),
        "stats": snapshot.rollup(rollups.HOURS).count(),
        "log": snapshot.total_rows,
    }
    print(
        json.dumps(
            {
                "metric": "seconds for the headline queries (median of 3) and both writes (one run), warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "input_rows": input_rows,
                "rows_read": rows_read,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
