"""Operators of a training-data pipeline over document tables."""

import sys

from pyspark import cloudpickle

# The functions of this package travel with the tasks, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
