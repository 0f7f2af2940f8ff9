"""prodlens: product-catalogue preparation, classification and active
learning expressed as Spark DataFrame / SQL / spark.ml jobs."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task: executors need numpy
# and pyarrow, but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
