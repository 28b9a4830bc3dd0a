"""stratum: insight mining and training-data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them carry its code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
