"""Sensitive-data scanning, redaction and audit analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python stages carry their code with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
