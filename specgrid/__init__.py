"""Specification-grid analysis of sequential trial data as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so the package needs to be on the driver only
cloudpickle.register_pickle_by_value(sys.modules[__name__])
