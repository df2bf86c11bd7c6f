"""quern: retrieval, evidence and training-data analytics as Spark DataFrame programs."""

from pyspark.cloudpickle import register_pickle_by_value as _by_value

# Functions that Spark sends to Python workers travel whole, so that a cluster needs no copy of this package.
_by_value(__import__(__name__))
