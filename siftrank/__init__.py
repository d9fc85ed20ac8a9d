"""siftrank: batch product search and search-quality measurement on Spark.

Everything takes and returns DataFrames.  Curation, index tables, retrieval,
reranking and evaluation are ordinary lazy plans; only models supplied by the
caller run in Python workers.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so the
# executors need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
