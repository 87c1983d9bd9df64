"""SQL for the registered queries, on the same tables and with the same arguments.

Each statement is a chain of common table expressions from ``events``: the records, their bronze
rows, the report per poll, the commits of the polls that pass, and the rows of the log.
"""

from __future__ import annotations

COLUMNS = (
    "icao24, callsign, origin_country, event_time, time_position, last_contact, longitude, "
    "latitude, baro_altitude, geo_altitude, on_ground, velocity, true_track, vertical_rate, "
    "squawk, spi, position_source, category, ingest_time, ingest_batch_id, source_name"
)

RECORDS = """
ev as (select *, cast(floor(epoch(ts)) as bigint) as ep,
  cast(floor(epoch(ts)) as bigint) // 86400 as poll from events),
rec as (select event_id, poll as poll_id,
  case when poll % 2 = 0 then 'feed_a' else 'feed_b' end as source_name,
  make_timestamp(((poll + 1) * 86400 + 5) * 1000000) as ingest_time,
  case when poll % 10 = 3 and event_id % 11 = 0 then null
       else lpad(lower(hex(user_id)), 6, '0') end as icao24,
  case when event_id % 13 = 0 then '   ' when event_id % 101 = 0 then ' LONGCALLSIGN '
       else upper(substr(event_type, 1, 3)) || cast(user_id as varchar) || '  ' end as callsign,
  case when event_id % 29 = 0 then null else event_type end as origin_country,
  case when event_id % 7 = 0 then null else ep end as time_position,
  case when poll % 10 = 3 and event_id % 11 = 1 then null
       else (ep // 600 + 1) * 600 end as last_contact,
  case when event_id % 17 = 0 then null when poll % 10 = 7 and event_id % 11 = 1 then -999.0::double
       else ((event_id * 104729) % 36000)::double / 100.0::double - 180.0::double end as longitude,
  case when event_id % 17 = 0 then null when poll % 10 = 7 and event_id % 11 = 0 then 999.0::double
       else ((event_id * 7919) % 18000)::double / 100.0::double - 90.0::double end as latitude,
  value * 20.0::double as baro_altitude,
  case when event_id % 19 = 0 then null when event_id % 103 = 0 then 90000.0::double
       else value * 20.0::double + 50.0::double end as geo_altitude,
  case when poll % 10 = 3 and event_id % 11 = 2 then null else event_id % 3 = 0 end as on_ground,
  value * 6.0::double as velocity,
  ((event_id * 37) % 360)::double as true_track,
  value / 10.0::double - 20.0::double as vertical_rate,
  case when event_id % 5 = 0 then null
       else lpad(cast(event_id % 8000 as varchar), 4, '0') end as squawk,
  event_id % 50 = 0 as spi,
  cast(case when event_id % 23 = 0 then null when event_id % 41 = 0 then 9
       else event_id % 4 end as integer) as position_source,
  cast(case when event_id % 31 = 0 then null else event_id % 20 end as integer) as category
  from ev)
"""

BRONZE = (
    RECORDS
    + """,
bronze as (select event_id, poll_id, icao24, nullif(trim(callsign), '') as callsign, origin_country,
  make_timestamp(coalesce(time_position, last_contact) * 1000000) as event_time, time_position,
  last_contact, longitude, latitude, baro_altitude, geo_altitude, on_ground, velocity, true_track,
  vertical_rate, squawk, spi, position_source, category, ingest_time,
  source_name || '/poll-' || poll_id as ingest_batch_id, source_name from rec)
"""
)

FIRST = """,
ranked as (select *, row_number() over (partition by poll_id, icao24, last_contact
  order by event_id) as rn from bronze),
dedup as (select * exclude (rn) from ranked
  where rn = 1 or icao24 is null or last_contact is null)
"""

# Name, test and report texts of each row rule, in report order.
RULES = (
    ("FAIL", "icao24", "not_nullable", "icao24 is null"),
    ("FAIL", "event_time", "not_nullable", "event_time is null"),
    ("FAIL", "last_contact", "not_nullable", "last_contact is null"),
    ("FAIL", "on_ground", "not_nullable", "on_ground is null"),
    ("FAIL", "ingest_time", "not_nullable", "ingest_time is null"),
    ("FAIL", "ingest_batch_id", "not_nullable", "ingest_batch_id is null"),
    ("FAIL", "source_name", "not_nullable", "source_name is null"),
    ("FAIL", "latitude", "in_range(-90.0, 90.0)", "latitude not between -90 and 90"),
    ("FAIL", "longitude", "in_range(-180.0, 180.0)", "longitude not between -180 and 180"),
    ("WARN", "velocity", "in_range(0.0, 1500.0)", "velocity not between 0 and 1500"),
    ("WARN", "geo_altitude", "in_range(-1000.0, 80000.0)", "geo_altitude not between -1000 and 80000"),
    ("WARN", "position_source", "isin([0, 1, 2, 3])", "position_source not in (0, 1, 2, 3)"),
    ("WARN", "callsign", "str_length(1, 8)", "length(callsign) not between 1 and 8"),
)
DUPLICATES = "duplicate (icao24, last_contact) rows present"


def _count(severity: str) -> str:
    return " + ".join(f"count(*) filter (where {t})" for s, _, _, t in RULES if s == severity)


def _report(rows: str) -> str:
    return f""",
twice as (select poll_id, max(n) > 1 as has_duplicates from (
  select poll_id, icao24, last_contact, count(*) as n from {rows} group by all) group by poll_id),
report as (select poll_id, count(*) as n_rows, {_count("FAIL")} as n_failures,
  {_count("WARN")} + cast(any_value(has_duplicates) as integer) as n_warnings,
  any_value(has_duplicates) as has_duplicates, {_count("FAIL")} = 0 as ok,
  case when count(last_contact) = count(*)
       then epoch(any_value(ingest_time)) - max(last_contact) end as lag_seconds
  from {rows} join twice using (poll_id) group by poll_id),
commits as (select poll_id, row_number() over (order by poll_id) as commit_seq,
  ((poll_id + 1) * 86400 + 5) * 1000 as timestamp_ms, n_rows from report where ok),
log as (select r.*, c.commit_seq, c.timestamp_ms from {rows} r join commits c using (poll_id))
"""


LOG = BRONZE + _report("bronze")
STREAM = BRONZE + FIRST + _report("dedup")


HOURLY = BRONZE.replace("bronze as (", "daily as (") + """,
bronze as (select d.* replace (e.ep // 3600 as poll_id, make_timestamp((e.ep // 3600 + 1) * 3600000000)
  as ingest_time) from daily d join ev e using (event_id))
""" + FIRST + _report("dedup")


def _with(chain: str, query: str) -> str:
    return f"with {chain.strip()} {query}"


def _log(query: str) -> str:
    return _with(LOG, query)


def _tie(*key: str, direction: str = "asc") -> str:
    rest = [c.strip() for c in COLUMNS.split(",") if c.strip() not in key]
    return ", ".join(f"{c} {direction} nulls last" for c in (*key, *rest))


PAGE_ORDER = _tie("event_time", "icao24")
NEWEST = _tie("last_contact", "event_time", "ingest_time", direction="desc")

IN_WINDOW = "event_time between timestamp '2024-01-09 06:00:00' and timestamp '2024-01-12 18:30:00'"
FROM_START = "event_time >= timestamp '2024-01-09 06:00:00'"
IN_BOX = "latitude between -30.0 and 45.5 and longitude between -100.0 and 60.0"
AS_OF_ID = "commit_seq <= 11"
AS_OF_TIME = "timestamp_ms <= epoch_ms(timestamp '2024-01-17 12:00:00')"


def _newest(rows: str, where: str = "true") -> str:
    return (
        f"select {COLUMNS} from (select *, row_number() over (partition by icao24 "
        f"order by {NEWEST}) as rn from {rows} where {where}) where rn = 1"
    )


def _stats(rows: str, interval: str, country: bool = False, where: str = "true") -> str:
    group = "origin_country" if country else "cast(null as varchar)"
    return (
        f"select cast(date_trunc('{interval}', event_time) as timestamp) as bucket_start, "
        f"{group} as grp, count(*) as cnt from {rows} where {where} group by 1, 2"
    )


def _results() -> str:
    """Batch log: every poll of the report, its status and its snapshot."""
    return """select case when r.poll_id % 2 = 0 then 'feed_a' else 'feed_b' end || '/poll-' || r.poll_id
    as batch_id, case when r.poll_id % 2 = 0 then 'feed_a' else 'feed_b' end as source_name,
  make_timestamp(((r.poll_id + 1) * 86400 + 5) * 1000000) as ingest_time,
  case when r.ok then 'appended' else 'dq_aborted' end as status, r.n_rows as rows_in,
  case when r.ok then r.n_rows else 0 end as rows_written, r.n_failures, r.n_warnings,
  cast(r.lag_seconds as double) as lag_seconds,
  nullif(count(c.commit_seq) over (order by r.poll_id), 0) as current_snapshot_id,
  count(c.commit_seq) over (order by r.poll_id) as snapshot_count, c.commit_seq as snapshot_id,
  case when r.ok then cast(sum(case when r.ok then r.n_rows else 0 end)
    over (order by r.poll_id) as bigint) end as total_rows
  from report r left join commits c using (poll_id)"""


_EMPTY_POLL = """ union all select case when p % 2 = 0 then 'feed_a' else 'feed_b' end || '/poll-' || p,
  case when p % 2 = 0 then 'feed_a' else 'feed_b' end,
  make_timestamp(((p + 1) * 86400 + 5) * 1000000), 'skipped_empty', 0, 0, 0, 0, null, n, n, null, null
  from (select max(poll_id) + 1 as p from rec), (select count(*) as n from commits)"""


def _rule_counts() -> str:
    parts = [
        f"select poll_id, count(*) as n_rows, '{s}' as severity, '{c}' as column_name, "
        f"'{k}' as check_name, count(*) filter (where {t}) as n_violations from bronze group by 1"
        for s, c, k, t in RULES
    ]
    parts.append(
        f"select poll_id, n_rows, 'WARN', null, '{DUPLICATES}', cast(has_duplicates as bigint) "
        "from report"
    )
    return " union all ".join(parts)


def _cases() -> str:
    parts = []
    for position, (severity, column, check, test) in enumerate(RULES, start=1):
        text = column == "callsign"
        number = "null" if text or check == "not_nullable" else f"cast({column} as double)"
        parts.append(
            f"select poll_id, '{severity}' as severity, {position} as position, "
            f"'{column}' as column_name, '{check}' as check_name, "
            f"cast({number} as double) as failure_number, "
            f"cast({column if text else 'null'} as varchar) as failure_text, "
            f"event_id as row_index from bronze where {test}"
        )
    parts.append(
        f"select poll_id, 'WARN', 0, null, '{DUPLICATES}', null, 'false', null from twice "
        "where has_duplicates"
    )
    return " union all ".join(parts)


def _case_summary() -> str:
    return f"""select poll_id, severity, rn as rank, column_name, check_name, failure_number,
  failure_text, row_index, n_cases, greatest(n_cases - 10, 0) as n_more from (
  select *, cast(row_number() over (partition by poll_id, severity
      order by position, row_index nulls first) as integer) as rn,
    count(*) over (partition by poll_id, severity) as n_cases from ({_cases()})) where rn <= 10"""


# Kind, severity, detail, test and shown column of each diagnosis rule, in listing order.
KINDS = (
    ("over_speed", "WARN", "velocity outside (0.0, 1500.0) m/s",
     "velocity not between 0 and 1500", "velocity"),
    ("unknown_position_source", "WARN", "position_source not in (0, 1, 2, 3)",
     "position_source not in (0, 1, 2, 3)", "position_source"),
    ("geo_altitude_out_of_range", "WARN", "geo_altitude outside (-1000.0, 80000.0) m",
     "geo_altitude not between -1000 and 80000", "geo_altitude"),
    ("callsign_length", "WARN", "callsign length outside (1, 8)",
     "length(callsign) not between 1 and 8", "callsign"),
    ("latitude_out_of_range", "FAIL", "latitude outside (-90.0, 90.0)",
     "latitude not between -90 and 90", "latitude"),
    ("longitude_out_of_range", "FAIL", "longitude outside (-180.0, 180.0)",
     "longitude not between -180 and 180", "longitude"),
    ("null_icao24", "FAIL", "required field ''icao24'' is null", "icao24 is null", None),
    ("null_event_time", "FAIL", "required field ''event_time'' is null", "event_time is null", None),
    ("null_last_contact", "FAIL", "required field ''last_contact'' is null", "last_contact is null", None),
    ("null_on_ground", "FAIL", "required field ''on_ground'' is null", "on_ground is null", None),
)
DUPLICATE_DETAIL = (
    "duplicate (icao24, last_contact) rows in the sample (expected across snapshots; "
    "within a single snapshot may indicate missing dedup)"
)

ACTIONS = {
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


def _surplus(rows: str) -> str:
    return (
        "select cast(coalesce(sum(n - 1), 0) as bigint) as surplus from (select icao24, last_contact, "
        f"count(*) as n from {rows} where icao24 is not null and last_contact is not null group by all)"
    )


def _findings(rows: str) -> str:
    parts = [
        f"select {position} as position, '{kind}' as kind, '{severity}' as severity, count(*) as n, "
        f"'{detail}' as detail, least(count(*), 5) as n_examples from {rows} where {test} "
        "having count(*) > 0"
        for position, (kind, severity, detail, test, _) in enumerate(KINDS)
    ]
    parts.append(
        f"select 10, 'duplicate_state_key', 'WARN', surplus, '{DUPLICATE_DETAIL}', 0 "
        f"from ({_surplus(rows)}) where surplus > 0"
    )
    return " union all ".join(parts)


def _finding_examples() -> str:
    parts = []
    for kind, _, _, test, shown in KINDS:
        text = shown == "callsign"
        number = "null" if text or shown is None else shown
        parts.append(
            f"select '{kind}' as kind, rn as rank, icao24, cast({number} as double) as value_number, "
            f"cast({shown if text else 'null'} as varchar) as value_text from (select *, "
            f"cast(row_number() over (order by {PAGE_ORDER}) as integer) as rn from bronze "
            f"where {test}) where rn <= 5"
        )
    return " union all ".join(parts)


MISSING = (
    f"select distinct icao24 from log where {AS_OF_TIME} and icao24 is not null and icao24 not in "
    "(select icao24 from log where icao24 is not null group by icao24 "
    "having max(event_time) >= (select max(event_time) from log) - interval 18 hours)"
)

_PRESENCE = """select icao24, min(event_time) as first_seen, max(event_time) as last_seen, count(*) as n_rows
  from (select *, sum(cast(away as integer)) over (partition by icao24 order by event_time
      rows unbounded preceding) as stay
    from (select icao24, event_time, coalesce(event_time - lag(event_time) over (partition by icao24
        order by event_time) > interval 18 hours, false) as away from log where icao24 is not null))
  group by icao24, stay"""


def _proposals() -> str:
    actions = " union all ".join(f"select '{k}' as key, '{a}' as action" for k, a in ACTIONS.items())
    return f"""select min(position) as position, key,
  'PROPOSED (requires human approval; not applied): ' || any_value(action) || '.' as proposal
  from (select position, case when kind like 'null\\_%' escape '\\' then 'null_required' else kind end
    as key from (select position, kind from ({_findings("bronze")})
      union all select 11, 'latest_state_gap' from ({MISSING}) having count(*) > 0))
  join ({actions}) using (key) group by key"""


def _diagnosis(rows: str, snapshot_id: str, bounded: str) -> str:
    return f"""select cast({snapshot_id} as bigint) as snapshot_id,
  (select count(*) from {rows}) as rows_examined, (select count(*) from {rows}) as returned,
  false as ok, 'Examined ' || (select count(*) from {rows}) || ' row(s) from flights at snapshot '
  || {snapshot_id} || '; bounded by {bounded}. Rule results are re-derived from the stored rows, '
  || 'not read from a history.' as limitations,
  count(*) over () as n_proposals, kind, severity, n from ({_findings(rows)})"""


def _thirds() -> str:
    return """,
span as (select min(poll_id) as lo, max(poll_id) as hi from rec),
graded as (select l.*, (l.poll_id - lo) * 3 // (hi - lo + 1) as part from log l, span)
"""


EVOLVED = LOG + _thirds()
#: The middle third is committed last; a snapshot is never older than the one before it.
LATE = (
    EVOLVED
    + """,
parted as (select c.*, (poll_id - lo) * 3 // (hi - lo + 1) as part from commits c, span),
late as (select *, row_number() over turn as seq, max(timestamp_ms) over turn as at_ms from parted
  window turn as (order by case part when 1 then 2 when 2 then 1 else 0 end, poll_id
    rows unbounded preceding))
"""
)
GRADE = "case part when 1 then 'B' when 2 then 'A' end"

FIELDS = (
    ("icao24", "string", True),
    ("callsign", "string", False),
    ("origin_country", "string", False),
    ("event_time", "timestamptz", True),
    ("time_position", "long", False),
    ("last_contact", "long", True),
    ("longitude", "double", False),
    ("latitude", "double", False),
    ("baro_altitude", "double", False),
    ("geo_altitude", "double", False),
    ("on_ground", "boolean", True),
    ("velocity", "double", False),
    ("true_track", "double", False),
    ("vertical_rate", "double", False),
    ("squawk", "string", False),
    ("spi", "boolean", False),
    ("position_source", "int", False),
    ("category", "int", False),
    ("ingest_time", "timestamptz", True),
    ("ingest_batch_id", "string", True),
    ("source_name", "string", True),
)


def _table_facts() -> str:
    fields = " union all ".join(
        f"select {i} as field_id, '{n}' as name, '{t}' as type, {str(r).lower()} as required"
        for i, (n, t, r) in enumerate(FIELDS, start=1)
    )
    return f"""select 'bronze.state_vectors' as table_identifier, current_snapshot_id, snapshot_count,
  'event_day' as partition_name, 'day' as partition_transform, 'event_time' as partition_source,
  field_id, name, type, required from ({fields}),
  (select max(commit_seq) as current_snapshot_id, count(*) as snapshot_count from commits)"""


_EVOLUTION_COUNTS = " union all ".join(
    f"select '{at}' as read_at, '{grade}' as grade, {has} as has_column, "
    f"count(*) filter (where {hit}) as n_rows from graded"
    for at, grade, has, hit in (
        ("before", "A", "false", "false"),
        ("before", "B", "false", "false"),
        ("now", "A", "true", f"{GRADE} = 'A'"),
        ("now", "B", "true", f"{GRADE} = 'B'"),
    )
)

ORACLE_SQL: dict[str, str] = {
    "raw_state_decode": _with(
        RECORDS,
        "select poll_id, event_id // 64 as seq, row_number() over (partition by poll_id, "
        "event_id // 64 order by event_id) - 1 as pos, icao24, callsign, origin_country, "
        "time_position, last_contact, longitude, latitude, baro_altitude, on_ground, velocity, "
        "true_track, vertical_rate, geo_altitude, squawk, spi, position_source, category from rec",
    ),
    "bronze_projection": _with(BRONZE, "select * from bronze"),
    "dedupe_within_batch": _with(
        RECORDS,
        "select * exclude (rn) from (select *, row_number() over (partition by poll_id, icao24, "
        "last_contact order by event_id) as rn from rec) "
        "where rn = 1 or icao24 is null or last_contact is null",
    ),
    "landed_polls_to_bronze": _with(BRONZE + FIRST, f"select {COLUMNS} from dedup"),
    "dq_rule_counts": _log(_rule_counts()),
    "dq_failure_cases": _log(_cases()),
    "dq_case_summary": _log(_case_summary()),
    "dq_batch_gate": _log(
        "select poll_id, n_rows, n_failures, n_warnings, has_duplicates, ok, "
        "case when ok then n_rows else 0 end as rows_written from report"
    ),
    "ingest_lag": _log("select poll_id, cast(lag_seconds as double) as lag_seconds from report"),
    "batch_results": _log(_results()),
    "flights_by_icao24": _log(
        f"select {COLUMNS} from log where icao24 = '000005' order by {PAGE_ORDER} limit 100"
    ),
    "flights_by_callsign": _log(
        f"select {COLUMNS} from log where callsign = 'VIE5' order by {PAGE_ORDER} limit 1000"
    ),
    "flights_time_window": _log(f"select {COLUMNS} from log where {IN_WINDOW}"),
    "flights_page": _log(
        f"select {COLUMNS} from log where {FROM_START} order by {PAGE_ORDER} limit 200 offset 150"
    ),
    "flights_page_by_day": _log(
        f"select {COLUMNS} from log where {FROM_START} order by {PAGE_ORDER} limit 200 offset 150"
    ),
    "flights_deep_page": _log(
        f"select {COLUMNS} from log order by {PAGE_ORDER} limit 300 offset 500"
    ),
    "flights_clamped": _log(
        f"select {COLUMNS}, cast(1000 as integer) as page_limit from log where {FROM_START} "
        f"order by {PAGE_ORDER} limit 1000"
    ),
    "flights_all_filters": _log(
        f"select {COLUMNS} from log where icao24 = '000005' and callsign = 'VIE5' and {FROM_START} "
        f"and event_time <= timestamp '2024-01-30' order by {PAGE_ORDER} limit 100"
    ),
    "bbox_page": _log(
        f"select {COLUMNS} from log where {FROM_START} and {IN_BOX} "
        f"order by {PAGE_ORDER} limit 200 offset 150"
    ),
    "bbox_all": _log(f"select {COLUMNS} from log where {IN_BOX}"),
    "latest_state": _log(_newest("log")),
    "latest_state_page": _log(_newest("log") + " order by icao24 nulls last limit 50 offset 3"),
    "latest_state_of_aircraft": _log(_newest("log", "icao24 = '000005'")),
    "latest_state_ungated": _log(_newest("bronze")),
    "stats_hour": _log(_stats("log", "hour")),
    "stats_day": _log(_stats("log", "day")),
    "stats_day_by_country": _log(_stats("log", "day", country=True)),
    "stats_hour_by_country_in_window": _log(_stats("log", "hour", country=True, where=IN_WINDOW)),
    "source_profile": _log(
        "select source_name, count(*) as n, min(event_time) as min_event, "
        "max(event_time) as max_event from log group by 1"
    ),
    "row_sample": _log(
        "select icao24, callsign, event_time, latitude, longitude, velocity, position_source, "
        f"source_name from log order by {PAGE_ORDER} limit 5"
    ),
    "snapshot_row_count": _log("select count(*) as n_rows from log"),
    "sql_view": _log(
        "select source_name, on_ground, count(*) as n, max(velocity) as max_velocity "
        "from log group by 1, 2"
    ),
    "snapshot_list": _log(
        "select commit_seq as snapshot_id, make_timestamp(timestamp_ms * 1000) as timestamp, "
        "'append' as operation, n_rows as added_records, "
        "cast(sum(n_rows) over (order by commit_seq) as bigint) as total_records from commits"
    ),
    "snapshot_history": _log("select commit_seq as snapshot_id, timestamp_ms from commits"),
    "snapshot_resolve": _log(
        f"select commit_seq as snapshot_id, timestamp_ms from commits where {AS_OF_TIME} "
        "order by timestamp_ms desc, commit_seq desc limit 1"
    ),
    "snapshot_state": _log(
        "select max(commit_seq) as snapshot_id, count(*) as snapshot_count from commits"
    ),
    "table_facts": _log(_table_facts()),
    "as_of_snapshot": _log(f"select {COLUMNS} from log where {AS_OF_ID}"),
    "as_of_timestamp": _log(
        f"select max(commit_seq) as snapshot_id, count(*) as n_rows from log where {AS_OF_TIME}"
    ),
    "as_of_many": _with(
        LATE,
        "select event_id, max(seq) as snapshot_id from ev left join late on at_ms <= epoch_ms(ts) group by event_id",
    ),
    "flights_as_of": _log(
        f"select {COLUMNS} from log where {AS_OF_TIME} and {FROM_START} and event_time <= "
        f"timestamp '2024-01-30' order by {PAGE_ORDER} limit 200 offset 150"
    ),
    "bbox_as_of": _log(f"select {COLUMNS} from log where {AS_OF_ID} and {IN_BOX}"),
    "latest_state_as_of": _log(_newest("log", AS_OF_TIME)),
    "stats_as_of": _log(_stats("log", "day", country=True, where=AS_OF_ID)),
    "expire_snapshots": _log(
        "select commit_seq as snapshot_id, timestamp_ms, n_rows as rows_written, "
        "row_number() over (order by timestamp_ms desc, commit_seq desc) > 10 as is_expired from commits"
    ),
    "rows_after_expiry": _log(_stats("log", "day")),
    "as_of_timestamp_late_batch": _with(
        LATE,
        " union all ".join(
            f"select '{name}' as read_at, max(seq) as snapshot_id, cast(sum(n_rows) as bigint) as n_rows "
            f"from late where at_ms <= epoch_ms(timestamp '{moment}')"
            for name, moment in (("during", "2024-01-17 12:00:00"), ("after", "2024-06-01"))
        ),
    ),
    "expire_with_late_batch": _with(
        LATE,
        "select seq as snapshot_id, case when poll_id % 2 = 0 then 'feed_a' else 'feed_b' end || "
        "'/poll-' || poll_id as batch_id, at_ms as timestamp_ms, "
        "seq <= (select count(*) from late) - 10 as is_expired from late",
    ),
    "schema_evolution_counts": _with(EVOLVED, _EVOLUTION_COUNTS),
    "evolved_rows": _with(EVOLVED, f"select {COLUMNS}, {GRADE} as data_quality_grade from graded"),
    "partition_layout": _with(
        EVOLVED,
        "select distinct cast(case when part = 2 then 1 else 0 end as integer) as spec_id, "
        "case when part = 2 then 'event_hour' else 'event_day' end as partition_name, "
        "case when part = 2 then cast(cast(floor(epoch(event_time)) as bigint) // 3600 as varchar) "
        "else strftime(event_time, '%Y-%m-%d') end as partition_value from graded",
    ),
    "evolved_window_read": _log(
        _stats("log", "hour", where=f"{FROM_START} and event_time <= timestamp '2024-01-30'")
    ),
    "anomaly_findings": _with(BRONZE, _findings("bronze")),
    "finding_examples": _with(BRONZE, _finding_examples()),
    "duplicate_surplus": _with(BRONZE, _surplus("bronze")),
    "latest_state_gap": _log(
        "select 'latest_state_gap' as kind, 'WARN' as severity, count(*) as n, "
        "string_agg(icao24, ',' order by icao24) filter (where rn <= 5) as first_missing "
        f"from (select icao24, row_number() over (order by icao24) as rn from ({MISSING})) "
        "having count(*) > 0"
    ),
    "missing_aircraft": _log(MISSING),
    "aircraft_presence": _log(_PRESENCE),
    "remediation_proposals": _log(_proposals()),
    "diagnose_snapshot": _log(_diagnosis("log", "(select max(commit_seq) from commits)", "the whole snapshot")),
    "diagnose_sample": _with(
        LOG
        + f""",
sample as (select * from log where {AS_OF_ID} and {FROM_START} order by {PAGE_ORDER} limit 500)""",
        _diagnosis("sample", "11", "the queried window and the row limit (500)"),
    ),
    "stream_batch_log": _with(STREAM, _results() + _EMPTY_POLL),
    "stream_two_feeds": _with(
        STREAM,
        "select source_name || '/poll-' || (poll_id // 2) as batch_id, source_name, status, "
        "rows_written, snapshot_id from (select *, cast(regexp_extract(batch_id, '\\d+$') as bigint) "
        f"as poll_id from ({_results() + _EMPTY_POLL}))",
    ),
    "stream_many_polls": _with(
        HOURLY,
        "select 'feed_h/poll-' || r.poll_id as batch_id, "
        "case when ok then 'appended' else 'dq_aborted' end as status, r.n_rows as rows_in, "
        "case when ok then r.n_rows else 0 end as rows_written, c.commit_seq as snapshot_id "
        "from report r left join commits c using (poll_id)",
    ),
    "stream_bronze": _with(STREAM, f"select {COLUMNS} from log"),
    "stream_interval_counts": _with(STREAM, _stats("log", "hour")),
    "stream_window_counts": _with(BRONZE, _stats("bronze", "hour", country=True, where="event_time is not null")),
    "stream_latest_state": _with(STREAM, _newest("log")),
}
