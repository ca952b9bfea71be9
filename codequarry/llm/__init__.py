"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are pickled by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
