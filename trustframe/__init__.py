"""trustframe: embedding reliability analytics as Spark jobs.

Every operator takes and returns DataFrames (or Columns).  Vectors are
``array<double>`` columns; models are small tables; streams are Structured
Streaming DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so a cluster does not
# need this package installed next to the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
