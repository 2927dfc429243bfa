"""DataFrame-to-DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel with the job; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
