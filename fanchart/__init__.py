"""fanchart: preparing, checking, scoring and ranking probabilistic forecasts on Spark."""

import sys

from pyspark import cloudpickle

# the few vectorised helpers travel with their tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
