"""Next-action analytics for call tables, planned and run by Spark.

Functions that run in tasks travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
