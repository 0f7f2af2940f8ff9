"""Operators of a training-data pipeline: mixing, chat formatting, near
duplicates, benchmark decontamination, URL rules, sharding, WARC archives,
quality classification, language-model scoring, quality outliers, repair and
prefix tries of conversations, and secret scans.

Nothing outside this package imports it, apart from the guarded registration
in ``__spark_entry__.py``.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so executors need
# numpy, pandas and pyarrow but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
