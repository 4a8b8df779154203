"""Land-use / land-cover analytics as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
