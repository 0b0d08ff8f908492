"""textloom: corpus curation and model-lifecycle analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Column functions travel to the executors by value, so a cluster needs no
# copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
