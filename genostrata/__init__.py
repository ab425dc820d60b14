"""Spark-native analytics over genomic-interval, variant-call, methylation and run-state tables."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
