"""frameloom: raster frames, geometric primitives and training data as DataFrames."""

import sys

from pyspark import cloudpickle

# What runs on executors is sent with the job, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
