"""Operators of a training-data pipeline over document, page and vector tables.

Functions of this subpackage travel to Python workers by value, so executors
need none of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
