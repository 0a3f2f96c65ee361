"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Its functions are shipped to the
executors by value, so a job needs no copy of the package on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
