"""Helpers of the operators: tables on the way, caches of a worker, words and columns."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.plans.scratch import new_folder

#: Space, tab, line feed, vertical tab, form feed and carriage return separate words.
BLANKS = " \t\n\x0b\x0c\r"
#: The same for Spark and DuckDB regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, purpose: str, partitioned: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read back: later steps and lost executors
    start from there."""
    spark = frame.sparkSession
    folder = new_folder(spark, f"llm-{purpose}")
    writer = frame.write.option("compression", "zstd")
    if partitioned:
        writer = writer.partitionBy(partitioned)
    writer.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def column_or_null(frame: DataFrame, name: str, kind: str):
    """A column by name, NULL where the table lacks it."""
    return frame[name].cast(kind) if name in frame.columns else F.lit(None).cast(kind)


def worker_cache(name: str, make: Callable[[], object]):
    """One object for each Python worker and name, kept between the tasks the worker runs.

    A name begins with the operator that owns the object and a colon. A worker keeps the objects of
    one owner at a time: those of another operator go when the first task of this one asks, so the
    stages of a pipeline do not add up in memory.
    """
    caches = vars(sys).setdefault("_statelog_llm_caches", {})
    owner = name.partition(":")[0]
    if caches.get("owner") != owner:
        caches.clear()
        caches["owner"] = owner
    if name not in caches:
        caches[name] = make()
    return caches[name]


def release() -> None:
    """Hand memory that is free back to the system, so that a worker without a task stays small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of a task's batches, after which the worker gives its free memory back."""

    @functools.wraps(rows)
    def wrapped(batches: Iterator) -> Iterator:
        yield from rows(batches)
        release()

    return wrapped


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batched(
    batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of a column, one row at least."""
    for batch in batches:
        # Offsets tell this; no text is copied.
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, length in enumerate(lengths):
            if i > start and total + length > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += length
        if len(lengths) > start:
            yield batch.slice(start)
    release()
