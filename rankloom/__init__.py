"""rankloom: evaluation-planning analytics and score-data preparation on Spark.

Every operator is a function from DataFrames to a DataFrame. ``rankloom.llm`` holds the
operators for training-data pipelines; nothing outside it imports it.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to Python workers by value, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
