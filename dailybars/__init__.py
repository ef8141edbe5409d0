"""Daily price-bar analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few task-side functions travel with their jobs, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
