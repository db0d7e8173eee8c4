"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import riskloom

# Python workers get the operators' functions with the task, so they need no install or path.
cloudpickle.register_pickle_by_value(riskloom)
