import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from statelog.operators.dedupe import first_per_state_key

SCHEMA = "batch int, n int, icao24 string, last_contact bigint, callsign string"


def expected(rows):
    seen, kept = set(), []
    for row in sorted(rows):
        key = (row[0], row[2], row[3])
        if row[2] is not None and row[3] is not None:
            if key in seen:
                continue
            seen.add(key)
        kept.append(row)
    return kept


def first(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(
        (tuple(r) for r in first_per_state_key(frame, ("n",), ("batch",)).collect()), key=lambda r: r[:2]
    )


def test_first_of_a_pair_stays(spark):
    rows = [(1, 0, "a", 5, "AAA"), (1, 1, "a", 5, "BBB"), (2, 0, "a", 5, "CCC"), (1, 2, "a", 6, "D")]
    assert [r[4] for r in first(spark, rows)] == ["AAA", "D", "CCC"]


def test_null_keys_pass(spark):
    rows = [(1, 0, None, 5, "x"), (1, 1, None, 5, "x"), (1, 2, "a", None, "x"), (1, 3, "a", None, "x")]
    assert first(spark, rows) == rows


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.integers(0, 1), st.sampled_from(["a", "b", None]),
                  st.sampled_from([1, 2, None])),
        min_size=1, max_size=30,
    )
)
def test_equals_brute_force(spark, keys):
    rows = [(b, n, i, c, f"s{n}") for n, (b, i, c) in enumerate(keys)]
    random.Random(0).shuffle(rows)
    assert first(spark, rows) == expected(rows)


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    hot = spark.range(0, 30000, 1, 8).selectExpr(
        "1 as batch", "cast(id as int) as n",
        "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id as string) end as icao24",
        "5L as last_contact", "cast(id as string) as callsign")
    kept = first_per_state_key(hot, ("n",), ("batch",))
    assert kept.count() == 1 + 10000 + 10000
    assert [r["n"] for r in kept.where("icao24 = 'hot'").collect()] == [0]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
