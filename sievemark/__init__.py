"""Evaluation of selective matching, and corpus operators, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
