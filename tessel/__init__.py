"""tessel — text-corpus, vector and evaluation operators on Spark DataFrames.

Every public operator takes and returns DataFrames so that Catalyst sees the
whole plan; see README.md for the module map.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions shipped to Python workers (mapInPandas / applyInPandas / batch
# inference) reference helpers in this package; pickling the package by value
# sends that code with the closure, so executors need no installed copy.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pyspark: ship the package with addPyFile instead
    pass
