"""Event-stream analytics on Spark: every operator is a function over DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their own code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
