"""Spark-native analytics over libraries of synced documents."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
