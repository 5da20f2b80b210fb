"""A PySpark-native engine for behavioural similarity over user-item event logs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the job, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
