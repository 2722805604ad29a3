"""Operators for preparing large text corpora, each in a module of its own.

Nothing outside this package imports it; ``registry`` lists its queries. Functions of this package
travel to the executors by value, so that only the driver needs the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
