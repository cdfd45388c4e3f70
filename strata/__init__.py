"""strata: subsurface radar survey analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames and works on any number of survey lines at once.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
