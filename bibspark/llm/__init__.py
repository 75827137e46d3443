"""Operators for preparing language-model training data.  Nothing else in the library imports them.

What runs in Python workers is pickled by value, so executors need no install of this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
