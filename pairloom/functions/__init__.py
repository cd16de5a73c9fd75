"""Column-level building blocks."""

from pyspark import cloudpickle

from pairloom.functions import overlap, ranges, text

# Executors then need no copy of this package for the Arrow functions.
for _module in (overlap, ranges, text):
    cloudpickle.register_pickle_by_value(_module)
