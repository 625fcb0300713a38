"""Veriloom: document verification and text data quality on Spark DataFrames.

Functions that run inside Spark's Python workers are pickled with their code, so that a cluster needs no installed
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
