"""Operators for preparing training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package go to executors by value: they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
