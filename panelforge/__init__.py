"""Panel analytics on PySpark: long date x symbol panels, Catalyst-first operators."""

import sys

from pyspark import cloudpickle

# Functions of this package go to executors by value: they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
