"""tallyforge: measure, score, attribute and compare structural quality over DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors as code, so that nothing needs to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
