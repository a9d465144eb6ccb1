"""textloom: text-corpus and model-data operators as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions handed to mapInPandas travel with the job, so that executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
