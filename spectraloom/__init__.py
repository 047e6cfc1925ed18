"""Spark-native analytics for peptide-identification data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Workers need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
