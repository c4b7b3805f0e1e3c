"""passagemill: build, search and measure passage corpora as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task code travels with its job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
