"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface; ``queries``
registers the thin contract queries over the given tables. Nothing else in
the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# The kernels travel inside the task closures, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
