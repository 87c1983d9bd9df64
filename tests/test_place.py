import random
import re

import pytest
from pyspark.sql import functions as F
from rows import at, announce, frame

from statelog.functions import place
from statelog.operators import reads


def cells(spark, points):
    rows = spark.createDataFrame(points, "latitude double, longitude double")
    return [r[0] for r in rows.select(place.cell(F.col("latitude"), F.col("longitude"))).collect()]


def test_cells_of_corners_and_odd_places(spark):
    last = (1 << 2 * place.BITS) - 1
    assert cells(spark, [(-90.0, -180.0), (90.0, 180.0)]) == [0, last]
    odd = [(None, 1.0), (1.0, None), (91.0, 0.0), (0.0, -180.5), (float("nan"), 0.0), (999.0, 999.0)]
    assert cells(spark, odd) == [None] * len(odd)


@pytest.mark.parametrize("most", [1, 2, 5, place.MOST_RANGES])
def test_ranges_hold_every_place_of_a_box(spark, most):
    pick = random.Random(most)
    points = [(pick.uniform(-90, 90), pick.uniform(-180, 180)) for _ in range(400)]
    points += [(lat, lon) for lat in (-90.0, 0.0, 90.0) for lon in (-180.0, 0.0, 180.0)]
    found = cells(spark, points)
    for _ in range(30):
        lats = sorted(pick.choice([-90, 90, pick.uniform(-90, 90)]) for _ in range(2))
        lons = sorted(pick.choice([-180, 180, pick.uniform(-180, 180)]) for _ in range(2))
        ranges = place.cell_ranges(*lats, *lons, most=most)
        assert 1 <= len(ranges) <= most
        assert all(a <= b < c for (a, b), (c, _) in zip(ranges, ranges[1:]))
        for (lat, lon), number in zip(points, found):
            if lats[0] <= lat <= lats[1] and lons[0] <= lon <= lons[1]:
                assert any(low <= number <= high for low, high in ranges)


def test_a_whole_globe_is_one_range_and_an_inverted_box_none():
    assert place.cell_ranges(-90, 90, -180, 180) == [(0, (1 << 2 * place.BITS) - 1)]
    assert place.cell_ranges(5, 4, 0, 1) == [] and place.cell_ranges(0, 1, 5, 4) == []


def _scans(rows):
    """The file scans of a plan that has run."""
    nodes, found = [rows._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            found.append(node)
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_a_box_is_pruned_by_place(spark, log, compiled):
    pick = random.Random(1)
    points = [(pick.uniform(-90, 90), pick.uniform(-180, 180)) for _ in range(4000)]
    points += [(None, 5.0), (5.0, None)]
    rows = [at(i % 3000, icao24=f"a{i % 50:03}", latitude=a, longitude=b, ingest_batch_id="b") for i, (a, b) in enumerate(points)]
    # Small pages, as a day of many rows has them.
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.page.row.count.limit", "100")
    try:
        log.ingest(frame(spark, rows), announce(spark, ("b", 1)), gate=False)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.page.row.count.limit")
    box = (40.0, 52.0, -5.0, 15.0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    found = log.scan(box=box)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(_cell", plan)
    assert "_cell" not in found.columns
    want = log.scan().where(reads.box_filter(*box))
    got = found.collect()
    assert sorted(map(str, got)) == sorted(map(str, want.collect())) and len(got) > 10
    # Rows that the scan puts out, before the exact box is checked.
    read = sum(scan.metrics().get("numOutputRows").get().value() for scan in _scans(found))
    assert len(got) <= read <= 1500
    for inverted in ((52.0, 40.0, -5.0, 15.0), (40.0, 52.0, 15.0, -5.0)):
        assert log.scan(box=inverted).count() == 0
    assert log.scan(box=(-90, 90, -180, 180)).count() == 4000
