"""Operators: functions from DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# functions travel to tasks with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
