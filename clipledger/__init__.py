"""Capture-evidence analytics on Spark: operators over tables of clips, frames, points and artifacts."""

import sys

from pyspark import cloudpickle

# Python helpers travel to executors by value, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
