"""Judge how well synthetic tables hide behind, and leak from, the real tables they imitate."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
