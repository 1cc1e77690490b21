"""jobatlas: labour-market analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Small helper functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
