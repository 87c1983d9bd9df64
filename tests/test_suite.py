import duckdb
import pytest
from compare import duck_rows, register_tables, spark_rows

import __spark_entry__ as contract
from pyspark.sql import functions as F
from statelog.suite import view
from statelog.suite.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    register_tables(connection, SF_DIR)
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, zone, compiled, name):
    zone("UTC")
    frame = contract.queries()[name](spark, SF_DIR)
    assert spark_rows(frame) == duck_rows(duck, contract.oracle_sql()[name])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for operator in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                     "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_polls_follow_each_other_in_time(spark, zone):
    zone("UTC")
    spans = view.bronze(spark, SF_DIR).groupBy("poll_id").agg(
        F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    spans = spans.orderBy("poll_id").collect()
    assert all(a["last"] < b["first"] for a, b in zip(spans, spans[1:]))


def test_entry(spark, zone):
    zone("UTC")
    assert contract.entry(spark).count() > 0
