"""Time-series panel analytics on Spark, with a subpackage for training-data work.

Functions that run inside Spark tasks travel with the task (pickled by value), so
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
