"""A Spark-native engine for imaging objects and their metadata."""

import os
import sys

from pyspark import cloudpickle

_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if _root not in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
    # Workers may not find the package: functions go to them by value. With the
    # package on PYTHONPATH they go by reference, which keeps tasks smaller.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
