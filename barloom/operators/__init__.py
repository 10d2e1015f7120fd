"""Operators on bars, quotes, trades and tables. Functions that run in tasks travel by value, so executors need numpy and
pyarrow but not this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
