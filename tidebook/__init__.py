"""Market analytics and text-corpus operators as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the query, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
