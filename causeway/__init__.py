"""Causal structure learning on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Spark's Python workers travel with their code, so
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
