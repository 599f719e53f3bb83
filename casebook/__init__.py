"""Spark operators for building research datasets from large text records."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
