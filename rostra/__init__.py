"""rostra: a PySpark-native engine for measuring topics in large speech corpora."""

import sys

from pyspark import cloudpickle

# Worker processes may not have this package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
