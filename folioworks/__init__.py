"""Document conformance analytics as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to the executors with the task, so that these need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
