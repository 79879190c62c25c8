"""Operators for preparing language-model training data.  Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their module's code, so that executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
