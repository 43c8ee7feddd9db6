"""Spark-native operators for scholarly documents, citations and the text corpora built from them."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python stages carry their own code to the executors, which need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
