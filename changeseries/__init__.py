"""Change-history analysis on Spark: series, matrices and clusters of change logs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the executors
# do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
