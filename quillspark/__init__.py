"""A Spark-native engine for knowledge retrieval and corpus analytics.

Its functions travel to the Python workers by value, so executors need no copy of the package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
