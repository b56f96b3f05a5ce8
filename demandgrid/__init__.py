"""Retail demand panel analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# the few NumPy helpers run in tasks travel with them: executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
