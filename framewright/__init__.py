"""Spark operators for speech and audio feature corpora."""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the tasks, so that workers need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
