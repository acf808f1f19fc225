"""Software-effort analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job: a worker needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
