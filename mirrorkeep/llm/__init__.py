"""Operators for preparing training text. Nothing else in the library imports this package.

Functions that run inside tasks travel by value, so executors need the third-party
libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
