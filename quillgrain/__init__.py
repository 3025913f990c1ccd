"""Spark-native analytics over text corpora, conversations, judgements and vectors.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``), so plans
compose with ``DataFrame.transform`` and stay visible to Catalyst.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
