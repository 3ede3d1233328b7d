"""bitloom: quantized feature preparation, scoring and stream analytics on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions run by executors travel with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
