"""Operators for preparing language-model training data. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to tasks by value, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
