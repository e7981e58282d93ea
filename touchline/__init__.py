"""Match-tracking analytics on Spark: trajectories, events, pressure, samples and metrics as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
