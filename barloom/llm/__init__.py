"""Operators for preparing training text. Nothing outside this folder imports it.

Functions that run in tasks travel by value, so executors need numpy, pyarrow and xxhash but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
