"""Operators for training-data pipelines; nothing else in the library imports them.

Their functions travel to the executors by value, so these need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
