"""Analytics over collections of Python source files, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions with them, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
