"""Offline search experiments over large text corpora, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors receive the small Python helpers used inside tasks together with
# the task itself, so the package need not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
