"""Retail pricing, sales and competitor analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
