"""Evidence-based claim verification on Spark. What runs on executors is pickled by value, so they need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
