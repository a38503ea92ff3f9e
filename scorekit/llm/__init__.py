"""Operators for preparing large text collections for model training.

Nothing else in the package imports this one. Every operator takes the names of the columns it reads, ignores all other
columns of its input, whatever they are called, and returns only the columns it documents.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
