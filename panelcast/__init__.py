"""Panel forecasting analytics as Spark jobs: clean, featurise, split, fit, backtest and report."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
