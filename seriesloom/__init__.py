"""Panel forecasting and forecast evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: workers need numpy and pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
