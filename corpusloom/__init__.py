"""Curation, comparison and evaluation of large code and text corpora as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so that executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
