"""The data-quality rule table. The ingest gate and the diagnosis both compile from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FAIL, WARN = "FAIL", "WARN"

# Thresholds, codes and lengths.
LATITUDE = (-90.0, 90.0)
LONGITUDE = (-180.0, 180.0)
VELOCITY = (0.0, 1500.0)
GEO_ALTITUDE = (-1000.0, 80000.0)
POSITION_SOURCES = (0, 1, 2, 3)
CALLSIGN_LENGTH = (1, 8)

NOT_NULL, RANGE, CODES, LENGTH = "not_null", "range", "codes", "length"


@dataclass(frozen=True)
class Rule:
    """One row rule: how to test a column, how the gate reports it, what the diagnosis calls it."""

    column: str
    severity: str
    test: str
    bounds: tuple = ()
    check: str = ""
    kind: str | None = None
    detail: str = ""

    @property
    def name(self) -> str:
        return f"{self.severity}:{self.column}"

    def violated(self, nan_is_null: bool) -> Column:
        """True where a row breaks the rule, never NULL."""
        value = F.col(self.column)
        if self.test == NOT_NULL:
            return value.isNull()
        if self.test == CODES:
            broken = ~value.isin(*self.bounds)
        elif self.test == LENGTH:
            broken = ~F.length(value).between(*self.bounds)
        else:
            broken = ~value.between(*self.bounds)
            if nan_is_null:
                broken = broken & ~F.isnan(value)
        return F.coalesce(broken, F.lit(False))


def _required(column: str, diagnosed: bool = True) -> Rule:
    return Rule(
        column,
        FAIL,
        NOT_NULL,
        check="not_nullable",
        kind=f"null_{column}" if diagnosed else None,
        detail=f"required field '{column}' is null",
    )


# Rules in report order, with the check texts of the report and the kinds and
# details of the diagnosis.
FAIL_RULES = (
    _required("icao24"),
    _required("event_time"),
    _required("last_contact"),
    _required("on_ground"),
    _required("ingest_time", diagnosed=False),
    _required("ingest_batch_id", diagnosed=False),
    _required("source_name", diagnosed=False),
    Rule("latitude", FAIL, RANGE, LATITUDE, f"in_range{LATITUDE}",
         "latitude_out_of_range", f"latitude outside {LATITUDE}"),
    Rule("longitude", FAIL, RANGE, LONGITUDE, f"in_range{LONGITUDE}",
         "longitude_out_of_range", f"longitude outside {LONGITUDE}"),
)
WARN_RULES = (
    Rule("velocity", WARN, RANGE, VELOCITY, f"in_range{VELOCITY}",
         "over_speed", f"velocity outside {VELOCITY} m/s"),
    Rule("geo_altitude", WARN, RANGE, GEO_ALTITUDE, f"in_range{GEO_ALTITUDE}",
         "geo_altitude_out_of_range", f"geo_altitude outside {GEO_ALTITUDE} m"),
    Rule("position_source", WARN, CODES, POSITION_SOURCES, f"isin({list(POSITION_SOURCES)})",
         "unknown_position_source", f"position_source not in {POSITION_SOURCES}"),
    Rule("callsign", WARN, LENGTH, CALLSIGN_LENGTH, f"str_length{CALLSIGN_LENGTH}",
         "callsign_length", f"callsign length outside {CALLSIGN_LENGTH}"),
)
ROW_RULES = FAIL_RULES + WARN_RULES

# Fixed value: the one rule on a whole batch, reported once however many rows repeat a key.
DUPLICATE_CHECK = "duplicate (icao24, last_contact) rows present"

# Order in which the diagnosis lists its kinds.
FINDING_ORDER = (
    "over_speed",
    "unknown_position_source",
    "geo_altitude_out_of_range",
    "callsign_length",
    "latitude_out_of_range",
    "longitude_out_of_range",
    "null_icao24",
    "null_event_time",
    "null_last_contact",
    "null_on_ground",
)


def diagnosis_rules() -> list[Rule]:
    """The rules the diagnosis re-derives, in listing order."""
    by_kind = {rule.kind: rule for rule in ROW_RULES if rule.kind}
    return [by_kind[kind] for kind in FINDING_ORDER]
