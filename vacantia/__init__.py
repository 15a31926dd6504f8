"""Vacantia: job-posting analytics as Spark DataFrame-to-DataFrame functions."""

import sys

from pyspark import cloudpickle

# Executors get the few Python helpers with the plan and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
