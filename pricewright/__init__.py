"""Pricewright: product listing comparison on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
