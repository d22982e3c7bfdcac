"""Quality and drift analytics for scored data feeds, on Spark."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their job, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
