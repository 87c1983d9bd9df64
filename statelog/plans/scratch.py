"""Folders that every executor can reach, for tables that a query writes on the way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names.

    A local master without one gets a temporary folder, removed when the program ends.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return _local_root()


_LOCAL: list[str] = []


def _local_root() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="statelog-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path of its own under the shared folder; nothing is created there yet."""
    return f"{shared_root(spark)}/statelog/{purpose}-{uuid.uuid4().hex}"
