"""Operators for preparing training data: scans, sharding, deduplication, packing, filtering, search, mixing, scoring."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
