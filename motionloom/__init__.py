"""Spark-native analytics for keyed inertial (and other numeric) time series."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions travel to executors by value, so workers need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
