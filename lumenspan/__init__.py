"""lumenspan: evidence analytics as Spark DataFrame plans.

The subpackages follow the life of a query: ``sources`` read and write tables,
``functions`` are column expressions, ``operators`` take and return DataFrames,
``plans`` compose them into retrieval, linking and evaluation runs and
``streaming`` applies the incremental ones to unbounded input.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with their code, so that executors
# need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
