"""textpool — labelled short-text pools, scoring and evaluation on Spark.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from the DataFrame API, Spark SQL functions, Spark ML
and Structured Streaming.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions of this package travel to the Python workers by value, so the
# executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
