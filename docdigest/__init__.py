"""Spark jobs that digest large collections of documents."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
