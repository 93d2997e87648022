"""Operators of a training-data pipeline: one module per operator, queries.py registers them.

Functions and models of this package travel to the executors by value, so that they need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
