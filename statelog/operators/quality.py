"""Data-quality report of bronze batches: totals per rule, failure cases, gate, ingest lag.

Every function takes rows of one or many batches and reports per ``batch`` column set, so that a
micro-batch of many polls is judged in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statelog.functions.rules import DUPLICATE_CHECK, FAIL, ROW_RULES, WARN
from statelog.schema import STATE_KEY

CASE_LIMIT = 10
BATCH = ("ingest_batch_id",)


def _marked(names: Sequence[str]) -> list[Column]:
    return [F.col(name).alias(f"_d_{name}") for name in names]


def _same(names: Sequence[str]) -> Column:
    """Null-safe equality of columns with their marked twins."""
    return reduce(and_, [F.col(name).eqNullSafe(F.col(f"_d_{name}")) for name in names])


def duplicate_batches(
    rows: DataFrame, batch: Sequence[str], deduplicated: bool = False
) -> DataFrame:
    """Batches in which some ``(icao24, last_contact)`` occurs twice; NULL keys equal each other.

    Rows that went through the first-per-key filter can only repeat a key with a NULL in it, so
    only those are counted when ``deduplicated``.
    """
    if deduplicated:
        rows = rows.where(F.col("icao24").isNull() | F.col("last_contact").isNull())
    return (
        rows.groupBy(*batch, *STATE_KEY)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(*batch)
        .distinct()
    )


def _tallies(rows: DataFrame, batch: Sequence[str]) -> DataFrame:
    """One row per batch: row count, violations per rule and the ingest lag."""
    counts = [F.count_if(rule.violated(nan_is_null=True)).alias(rule.name) for rule in ROW_RULES]
    every_contact = (F.count("last_contact") == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0)
    ingest_epoch = F.unix_micros(F.max("ingest_time")) / 1e6
    lag = F.when(every_contact, ingest_epoch - F.max("last_contact"))
    return rows.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n_rows"), lag.alias("lag_seconds"), *counts
    )


def batch_report(
    rows: DataFrame, batch: Sequence[str] = BATCH, deduplicated: bool = False
) -> DataFrame:
    """One row per batch: ``n_rows, n_failures, n_warnings, has_duplicates, ok, lag_seconds``.

    ``lag_seconds`` is the ingest time less the newest contact, NULL unless every row has one. All
    rules are counted; none stops the others. The per-rule totals stay as ``<severity>:<column>``.
    """
    twice = duplicate_batches(rows, batch, deduplicated)
    flagged = twice.select(*_marked(batch), F.lit(True).alias("_twice"))
    failures = sum((F.col(f"`{r.name}`") for r in ROW_RULES if r.severity == FAIL), F.lit(0))
    warnings = sum((F.col(f"`{r.name}`") for r in ROW_RULES if r.severity == WARN), F.lit(0))
    tallies = _tallies(rows, batch)
    joined = tallies.join(flagged, _same(batch), "left")
    has_duplicates = F.col("_twice").isNotNull()
    return joined.select(
        *batch,
        "n_rows",
        failures.cast("bigint").alias("n_failures"),
        (warnings + has_duplicates.cast("int")).cast("bigint").alias("n_warnings"),
        has_duplicates.alias("has_duplicates"),
        (failures == 0).alias("ok"),
        "lag_seconds",
        *[f"`{rule.name}`" for rule in ROW_RULES],
    )


def rule_counts(rows: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """One row per batch and rule: ``severity, column, check, n_rows, n_violations``.

    All rules are tallied in one aggregate; the totals are turned to rows afterwards.
    """
    entries = [
        F.struct(
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.column).alias("column"),
            F.lit(rule.check).alias("check"),
            F.col(f"`{rule.name}`").alias("n_violations"),
        )
        for rule in ROW_RULES
    ]
    entries.append(
        F.struct(
            F.lit(WARN).alias("severity"),
            F.lit(None).cast("string").alias("column"),
            F.lit(DUPLICATE_CHECK).alias("check"),
            F.col("has_duplicates").cast("bigint").alias("n_violations"),
        )
    )
    report = batch_report(rows, batch)
    return report.select(*batch, "n_rows", F.explode(F.array(*entries)).alias("_r")).select(
        *batch, "n_rows", "_r.*"
    )


def failure_cases(rows: DataFrame, index: str, batch: Sequence[str] = BATCH) -> DataFrame:
    """One row per violation: ``severity, position, column, check, failure_case, index``.

    ``index`` names the column with the row's place in its batch. ``position`` is the rule's place
    in the report; the one duplicate case of a batch comes first among its warnings.
    """
    cases = [
        F.when(
            rule.violated(nan_is_null=True),
            F.struct(
                F.lit(rule.severity).alias("severity"),
                F.lit(position).alias("position"),
                F.lit(rule.column).alias("column"),
                F.lit(rule.check).alias("check"),
                F.col(rule.column).cast("string").alias("failure_case"),
            ),
        )
        for position, rule in enumerate(ROW_RULES, start=1)
    ]
    # Empty entries are dropped after the explode; a filter on the array would run interpreted.
    row_cases = rows.select(
        *batch,
        F.col(index).cast("bigint").alias("index"),
        F.explode(F.array(*cases)).alias("_c"),
    ).where("_c is not null").select(*batch, "_c.*", "index")
    batch_cases = duplicate_batches(rows, batch).select(
        *batch,
        F.lit(WARN).alias("severity"),
        F.lit(0).alias("position"),
        F.lit(None).cast("string").alias("column"),
        F.lit(DUPLICATE_CHECK).alias("check"),
        F.lit("false").alias("failure_case"),
        F.lit(None).cast("bigint").alias("index"),
    )
    return row_cases.unionByName(batch_cases)


def case_summary(
    rows: DataFrame, index: str, batch: Sequence[str] = BATCH, limit: int = CASE_LIMIT
) -> DataFrame:
    """The first ``limit`` cases per batch and severity, each with ``n_cases`` and ``n_more``."""
    cases = failure_cases(rows, index, batch)
    window = Window.partitionBy(*batch, "severity").orderBy(
        "position", F.col("index").asc_nulls_first()
    )
    head = cases.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
    # Every violation is a case, so the report already counts them.
    totals = batch_report(rows, batch).select(*_marked(batch), "n_failures", "n_warnings")
    head = head.join(totals, _same(batch)).withColumn(
        "n_cases",
        F.when(F.col("severity") == FAIL, F.col("n_failures")).otherwise(F.col("n_warnings")),
    )
    return head.select(
        *batch,
        "severity",
        "rank",
        "column",
        "check",
        "failure_case",
        "index",
        "n_cases",
        F.greatest(F.col("n_cases") - limit, F.lit(0)).cast("bigint").alias("n_more"),
    )
