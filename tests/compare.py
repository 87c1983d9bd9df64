"""Compare a Spark result with a DuckDB result: names, row count and values, rows in any order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, datetime | date):
        return value.isoformat()
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    keyed = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(keyed, key=repr)


def spark_rows(frame):
    return sorted(frame.columns), sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), sorted_rows(names, cursor.fetchall())


def register_tables(connection, sf_dir):
    import pathlib

    for path in pathlib.Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
