"""Operators for building training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no copy of this package on their import path. Broadcast values are
# not covered: they must be made of plain types and arrays.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
