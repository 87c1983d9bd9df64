"""statelog: an append-only state-vector log on PySpark.

Landed poll payloads become a typed bronze table; batches are gated on data-quality rules and
recorded as snapshots; reads answer pages, boxes, latest state, interval counts and diagnoses on
the current or any earlier snapshot. Everything is DataFrame work with built-in functions.
"""

from statelog.plans.log import AsOfConflictError, SnapshotNotFoundError, StateLog

__all__ = ["AsOfConflictError", "SnapshotNotFoundError", "StateLog"]
