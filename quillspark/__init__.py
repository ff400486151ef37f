"""Spark-native text retrieval, curation and training-data engine."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Workers need no copy of this package: its functions travel inside the tasks that use them.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
