"""Tablemill: typed relational operators, record analytics and corpus jobs on PySpark."""

import sys

from pyspark import cloudpickle

__all__ = ["__version__"]
__version__ = "0.1.0"

#: Functions of this package travel to the executors by value, so that it need be installed on the driver alone.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
