"""Vecloom: vector analytics on Spark DataFrames.

Functions shipped to Python workers are pickled by value, so executors need
PySpark and its Arrow stack but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
