"""Operators of a training-data pipeline: extraction, filters, deduplication, scoring and packing.

Their functions travel to the executors by value, so a job does not depend on the package being
installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
