"""String clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that Python's strip() also removes.
_BLANKS_AT_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def clean_callsign(raw: Column) -> Column:
    """Callsign without surrounding blanks; an empty one is NULL."""
    return F.nullif(F.regexp_replace(raw, _BLANKS_AT_ENDS, ""), F.lit(""))
