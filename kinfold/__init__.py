"""Entity resolution analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
