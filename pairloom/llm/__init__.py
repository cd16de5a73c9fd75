"""Operators for cleaning and preparing large text corpora."""

import sys

from pyspark import cloudpickle

# Executors then need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
