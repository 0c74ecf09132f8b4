"""Commerce analytics on Spark: validation, order facts, KPIs, segments, growth signals,
corpus retrieval, report audit and action log, all as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python tasks carry the package's functions by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
