"""Training-data operators on Spark; nothing outside this subpackage imports it.

Functions sent to executors are pickled by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
