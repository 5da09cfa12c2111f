"""Operators for preparing training data.

Nothing else in the library imports this subpackage. Its functions travel
with the jobs that use them, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
