"""Spark track analytics: boxes, identities and labels over frames, as DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
