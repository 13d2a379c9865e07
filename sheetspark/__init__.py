"""Spreadsheet-style data work on large collections of tables, on Spark.

Sub-packages: ``functions`` (Column expressions), ``operators``
(DataFrame -> DataFrame), ``sources`` and ``sinks`` (files), ``plans``
(the registered queries with their SQL twins).
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions run in Python workers travel by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
