"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("statelog-tests")
        .config("spark.sql.shuffle.partitions", "4")
        # Compiling code costs more than running it on a few literal rows; the comparison with SQL
        # turns it on.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def zone(spark):
    """Set the session time zone for a test."""
    before = spark.conf.get("spark.sql.session.timeZone")

    def change(name):
        spark.conf.set("spark.sql.session.timeZone", name)

    yield change
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.fixture
def compiled(spark):
    """Whole-stage code generation, as sessions have it by default."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.fixture
def log(spark):
    from statelog import StateLog
    from statelog.plans.scratch import new_folder

    return StateLog(spark, new_folder(spark, "test-log"))
