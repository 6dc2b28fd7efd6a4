"""Operators of a training-data pipeline; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole: workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
