"""Training-data operators: ten components and the queries that apply them to whole tables.

Nothing outside this subpackage imports it.  Its functions travel to the Python workers by value, so
executors need no copy of the package.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
