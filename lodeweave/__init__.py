"""Spark-native record resolution engine."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
