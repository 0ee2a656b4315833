"""Spark-native research-intake and provenance analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code, so that executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
