"""Analytics over tagged geographic features, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so a cluster need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
