"""Spark jobs for text corpora, byte-level BPE vocabularies and model evaluation tables."""

import sys

from pyspark import cloudpickle

# Arrow and pandas functions travel to the executors by value, so the workers
# need no copy of this package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
