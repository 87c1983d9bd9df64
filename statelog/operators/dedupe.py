"""First record per state key within a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelog.schema import STATE_KEY


def first_per_state_key(
    records: DataFrame, order: Sequence[str], batch: Sequence[str] = ()
) -> DataFrame:
    """Keep the first record, by ``order``, of each ``(icao24, last_contact)`` of a batch.

    A record with a NULL in its key always passes. Such records get an id of their own as a further
    key, which also spreads them over the tasks. The filter on the rank alone lets Spark cut each
    map task's records to one per key before the shuffle, so a hot key stays small. A hash of the
    key comes first in the sort, which settles most comparisons by one number.
    """
    no_key = F.col("icao24").isNull() | F.col("last_contact").isNull()
    alone = F.when(no_key, F.monotonically_increasing_id())
    key = (*batch, *STATE_KEY, "_alone")
    window = Window.partitionBy("_hash", *key).orderBy(*order)
    return (
        records.withColumn("_alone", alone)
        .withColumn("_hash", F.xxhash64(*key))
        .withColumn("_rank", F.row_number().over(window))
        .where("_rank = 1")
        .drop("_alone", "_hash", "_rank")
    )
