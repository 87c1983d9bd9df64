"""Cells of the globe along a space-filling curve, and boxes as ranges of cells.

Latitude and longitude are cut into ``2 ** BITS`` steps each; the bits of the two step numbers
alternate in the cell number (Z-order). Neighbouring cells mostly have near numbers, so a box is a
few ranges of them, which a scan compares with the bounds of its files and pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of 2.8 degrees of latitude and 5.6 of longitude.
BITS = 6
#: Ranges that a box is covered by, at most; the nearest ones are joined then.
MOST_RANGES = 16

_SPAN = {"latitude": 90.0, "longitude": 180.0}


def _step(value: Column, span: float) -> Column:
    """The number of a coordinate's step; the upper end belongs to the last one."""
    step = F.floor((value + span) * ((1 << BITS) / (2 * span)))
    return F.least(step, F.lit((1 << BITS) - 1)).cast("bigint")


def cell(latitude: Column, longitude: Column) -> Column:
    """The cell of a place; NULL outside the globe and without a coordinate."""
    lat, lon = _step(latitude, _SPAN["latitude"]), _step(longitude, _SPAN["longitude"])
    number = F.lit(0).cast("bigint")
    for bit in range(BITS):
        for shift, step in ((2 * bit, lon), (2 * bit + 1, lat)):
            number = number.bitwiseOR(F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1)), shift))
    inside = latitude.between(-90, 90) & longitude.between(-180, 180)
    return F.when(inside, number)


def _steps(low: float, high: float, span: float) -> range:
    scale, last = (1 << BITS) / (2 * span), (1 << BITS) - 1
    first, end = (min(math.floor((v + span) * scale), last) for v in (low, high))
    return range(max(first, 0), end + 1)


def _interleaved(lat: int, lon: int) -> int:
    return sum(((lon >> b & 1) << (2 * b)) | ((lat >> b & 1) << (2 * b + 1)) for b in range(BITS))


def cell_ranges(
    min_lat: float, max_lat: float, min_lon: float, max_lon: float, most: int = MOST_RANGES
) -> list[tuple[int, int]]:
    """Ranges of cells, both ends included, that hold every place of a box; none for an empty box."""
    if min_lat > max_lat or min_lon > max_lon:
        return []
    cells = sorted(
        _interleaved(lat, lon)
        for lat in _steps(min_lat, max_lat, _SPAN["latitude"])
        for lon in _steps(min_lon, max_lon, _SPAN["longitude"])
    )
    # The widest gaps part the ranges.
    gaps = sorted(range(1, len(cells)), key=lambda i: cells[i - 1] - cells[i])
    starts = sorted(i for i in gaps[: most - 1] if cells[i] - cells[i - 1] > 1)
    bounds = [0, *starts, len(cells)]
    return [(cells[a], cells[b - 1]) for a, b in zip(bounds, bounds[1:])]


def in_ranges(column: str, ranges: list[tuple[int, int]]) -> Column:
    """Whether a column lies in one of the ranges; the comparisons reach a Parquet scan."""
    found = F.lit(False)
    for low, high in ranges:
        found = found | F.col(column).between(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))
    return found
