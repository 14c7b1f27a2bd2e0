"""Operators for building training corpora. Nothing outside this package uses it.

Functions that run in Python workers travel with the job instead of being
imported there, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
