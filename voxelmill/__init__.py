"""Spark-native analytics over grouped 3-D point tables.

The kernels that run in Python workers are shipped by value, so executors need
Spark's Python dependencies only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
