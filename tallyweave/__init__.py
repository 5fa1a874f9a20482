"""Multi-modal next-purchase recommendation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors whole, so nothing needs to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
