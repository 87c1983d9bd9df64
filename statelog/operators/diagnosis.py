"""Diagnosis of stored rows: findings, duplicate surplus, coverage gaps, proposals."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statelog.functions.clock import utc_hour_number
from statelog.functions.rules import NOT_NULL, WARN, diagnosis_rules
from statelog.operators.reads import page_order

EXAMPLES = 5

DUPLICATE_KIND = "duplicate_state_key"
GAP_KIND = "latest_state_gap"

# Finding details.
DUPLICATE_DETAIL = (
    "duplicate (icao24, last_contact) rows in the sample (expected across snapshots; "
    "within a single snapshot may indicate missing dedup)"
)
GAP_DETAIL = "aircraft present in the older snapshot but absent from the current sample"

# Proposed action per kind, the action for any other kind, and the text around it.
REMEDIATIONS = {
    "over_speed": "review the source velocity calibration or add a stricter ingest filter",
    "unknown_position_source": "map or quarantine unknown position_source codes at ingest",
    "geo_altitude_out_of_range": "clamp or reject implausible geo_altitude at ingest",
    "callsign_length": "trim/validate callsign formatting at ingest",
    "latitude_out_of_range": "reject rows with invalid latitude (already a FAIL rule)",
    "longitude_out_of_range": "reject rows with invalid longitude (already a FAIL rule)",
    "null_required": "investigate why a required field is null and fix the upstream source",
    "duplicate_state_key": "verify within-batch dedup on (icao24, last_contact)",
    "latest_state_gap": "confirm whether the missing aircraft are expected to have dropped off",
}
DEFAULT_REMEDIATION = "investigate the affected rows and correct the source"
PROPOSAL = "PROPOSED (requires human approval; not applied): %s."

_RULES = diagnosis_rules()


def _value(rule) -> Column:
    """The offending value as text; a missing required field has none to show."""
    return F.lit(None).cast("string") if rule.test == NOT_NULL else F.col(rule.column).cast("string")


def anomaly_counts(rows: DataFrame) -> DataFrame:
    """``position, kind, severity, count, detail`` of each rule that some row breaks.

    One aggregate without a key counts every rule; its single row is then turned to rows.
    """
    totals = rows.agg(*[F.count_if(rule.violated(nan_is_null=False)).alias(rule.kind) for rule in _RULES])
    entries = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.severity).alias("severity"),
            F.col(rule.kind).alias("count"),
            F.lit(rule.detail).alias("detail"),
        )
        for position, rule in enumerate(_RULES)
    ]
    return totals.select(F.inline(F.array(*entries))).where("count > 0")


def finding_examples(rows: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """The first ``limit`` offending rows, in page order, of each kind.

    A row is tagged with the kinds it breaks; the rank filter cuts every map task's rows to
    ``limit`` per kind before the shuffle, however common a kind is.
    """
    tags = [
        F.when(
            rule.violated(nan_is_null=False),
            F.struct(F.lit(position).alias("position"), F.lit(rule.kind).alias("kind"),
                     _value(rule).alias("value")),
        )
        for position, rule in enumerate(_RULES)
    ]
    order = page_order(rows)
    tagged = rows.withColumn("_tag", F.explode(F.array(*tags))).where("_tag is not null")
    window = Window.partitionBy("_tag.position").orderBy(*order)
    return (
        tagged.withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= limit)
        .select("_tag.position", "_tag.kind", "rank", "icao24", F.col("_tag.value").alias("value"))
    )


def duplicate_surplus(rows: DataFrame) -> DataFrame:
    """How many rows repeat the ``(icao24, last_contact)`` of another; keys with NULL are ignored."""
    keyed = rows.where(F.col("icao24").isNotNull() & F.col("last_contact").isNotNull())
    per_key = keyed.groupBy("icao24", "last_contact").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def _with_examples(counts: DataFrame, examples: DataFrame) -> DataFrame:
    """Attach each kind's examples, at most ``EXAMPLES`` per kind by construction."""
    listed = examples.groupBy("position").agg(
        F.array_sort(F.collect_list(F.struct("rank", "icao24", "value"))).alias("_ranked")
    )
    shown = F.transform("_ranked", lambda e: F.struct(e["icao24"].alias("icao24"),
                                                      e["value"].alias("value")))
    return counts.join(listed, "position", "left").select(
        "position", "kind", "severity", "count", "detail",
        F.coalesce(shown, F.array().cast("array<struct<icao24: string, value: string>>")).alias(
            "examples"
        ),
    )


def detect_anomalies(rows: DataFrame) -> DataFrame:
    """Findings with a positive count, in listing order by ``position``."""
    found = _with_examples(anomaly_counts(rows), finding_examples(rows))
    repeated = duplicate_surplus(rows).where("surplus > 0").select(
        F.lit(len(_RULES)).alias("position"),
        F.lit(DUPLICATE_KIND).alias("kind"),
        F.lit(WARN).alias("severity"),
        F.col("surplus").alias("count"),
        F.lit(DUPLICATE_DETAIL).alias("detail"),
        F.array().cast("array<struct<icao24: string, value: string>>").alias("examples"),
    )
    return found.unionByName(repeated)


def _side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames in one row."""
    stacked = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True), one_row_frames
    )
    return stacked.agg(*[F.first(n, ignorenulls=True).alias(n) for n in stacked.columns])


def presence(rows: DataFrame, silence: timedelta) -> DataFrame:
    """When each aircraft was there: ``icao24, first_seen, last_seen, n_rows`` for every stay.

    A stay ends where an aircraft is silent for longer than ``silence``, an hour or more. Rows combine
    by aircraft and hour in each map task first, so an aircraft with a large share of all rows is
    as many rows as it has hours; stays are islands of those. NULL is no aircraft.
    """
    if silence < timedelta(hours=1):
        raise ValueError("silence must be an hour or more")
    seen = rows.where("icao24 is not null and event_time is not null")
    hours = seen.groupBy("icao24", utc_hour_number(F.col("event_time")).alias("_hour")).agg(
        F.min("event_time").alias("_first"), F.max("event_time").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    in_time = Window.partitionBy("icao24").orderBy("_hour")
    away = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(in_time))
    starts = hours.withColumn("_new", (away > silence // timedelta(microseconds=1)).cast("int"))
    stays = starts.withColumn("_stay", F.coalesce(F.sum("_new").over(in_time), F.lit(0)))
    return stays.groupBy("icao24", "_stay").agg(
        F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"), F.sum("_n").alias("n_rows")
    ).drop("_stay")


def still_present(rows: DataFrame, silence: timedelta) -> DataFrame:
    """``icao24`` of the aircraft whose last stay goes on: not silent for longer than ``silence``
    before the newest event of all rows."""
    stays = presence(rows, silence)
    newest = rows.agg(F.max(F.unix_micros("event_time"))).scalar()
    quiet = newest - F.unix_micros("last_seen")
    return stays.where(quiet <= silence // timedelta(microseconds=1)).select("icao24")


def missing_aircraft(current: DataFrame, older: DataFrame) -> DataFrame:
    """Aircraft of the older rows that the current rows lack; NULL is no aircraft."""
    seen = older.where("icao24 is not null").select("icao24").distinct()
    return seen.join(current.select("icao24"), "icao24", "left_anti")


def latest_state_gap(current: DataFrame, older: DataFrame) -> DataFrame:
    """One finding with the number of missing aircraft and the first of them, or no row."""
    missing = missing_aircraft(current, older)
    total = missing.agg(F.count(F.lit(1)).alias("count"))
    first = missing.orderBy("icao24").limit(EXAMPLES).agg(
        F.array_sort(F.collect_list("icao24")).alias("ids")
    )
    example = F.transform(
        "ids", lambda i: F.struct(i.alias("icao24"), F.lit(None).cast("string").alias("value"))
    )
    return _side_by_side(total, first).where("count > 0").select(
        F.lit(len(_RULES) + 1).alias("position"),
        F.lit(GAP_KIND).alias("kind"),
        F.lit(WARN).alias("severity"),
        "count",
        F.lit(GAP_DETAIL).alias("detail"),
        example.alias("examples"),
    )


def propose_remediations(findings: DataFrame) -> DataFrame:
    """One proposal per distinct kind, in order of its first finding: ``position, key, proposal``.

    All missing required fields share one proposal. The actions are a fixed map of nine entries.
    """
    key = F.when(F.startswith("kind", F.lit("null_")), F.lit("null_required")).otherwise(
        F.col("kind")
    )
    entries = [F.lit(text) for pair in REMEDIATIONS.items() for text in pair]
    action = F.coalesce(
        F.try_element_at(F.create_map(*entries), F.col("key")), F.lit(DEFAULT_REMEDIATION)
    )
    return (
        findings.groupBy(key.alias("key"))
        .agg(F.min("position").alias("position"))
        .select("position", "key", F.format_string(PROPOSAL, action).alias("proposal"))
    )


def sample_limit(requested: int | None, max_rows: int) -> int:
    """Rows a bounded diagnosis looks at."""
    return min(requested or max_rows, max_rows)


def diagnose(
    rows: DataFrame,
    snapshot_id: int | None,
    endpoint: str = "flights",
    requested_limit: int | None = None,
    extra: Sequence[DataFrame] = (),
    returned: int | None = None,
) -> DataFrame:
    """One record: rows examined and returned, findings, proposals, statement of limits, ``ok``.

    ``returned`` is the count that the read reported, the rows examined unless it is given.

    Findings and proposals are at most one per kind, so gathering them is bounded. ``extra`` adds
    findings of other checks, such as a coverage gap. Without ``requested_limit`` the rows are the
    whole snapshot.
    """
    findings = detect_anomalies(rows)
    for more in extra:
        findings = findings.unionByName(more)
    listed = findings.agg(
        F.array_sort(
            F.collect_list(F.struct("position", "kind", "severity", "count", "detail", "examples"))
        ).alias("findings")
    )
    proposed = propose_remediations(findings).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "proposal"))), lambda p: p["proposal"]
        ).alias("proposals")
    )
    examined = rows.agg(F.count(F.lit(1)).alias("rows_examined"))
    bounded = (
        F.lit("the whole snapshot.")
        if requested_limit is None
        else F.lit(f"the queried window and the row limit ({requested_limit}).")
    )
    limitations = F.concat(
        F.lit("Examined "),
        F.col("rows_examined").cast("string"),
        F.lit(f" row(s) from {endpoint} at snapshot {snapshot_id}; bounded by "),
        bounded,
        F.lit(" Rule results are re-derived from the stored rows, not read from a history."),
    )
    return _side_by_side(examined, listed, proposed).select(
        F.lit(snapshot_id).cast("bigint").alias("snapshot_id"),
        F.lit(endpoint).alias("endpoint"),
        "rows_examined",
        F.coalesce(F.lit(returned).cast("bigint"), "rows_examined").alias("returned"),
        F.lit(requested_limit).cast("bigint").alias("requested_limit"),
        "findings",
        "proposals",
        limitations.alias("limitations"),
        (F.size("findings") == 0).alias("ok"),
    )
