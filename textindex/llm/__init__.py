"""Training-data operators: dedup, mixing, scans, archives, formatting and search."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need not have this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
