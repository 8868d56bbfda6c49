"""tapflow: smart-card ridership analytics expressed as Spark DataFrame plans.

Taps (one row per card ride) and routes (one row per stop occurrence on a
service-direction) go in; origin-destination tables, boarding and alighting
totals, running on-board load, vehicle counts, feature vectors, distances,
clusterings and chart tables come out. Every operator is a function from
DataFrame(s) to DataFrame that works on all services and directions at once.
"""

import sys

from pyspark import cloudpickle

from tapflow.model import ROUTE_KEY, RouteColumns, TapColumns

# Pair kernels travel inside the task closures, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ROUTE_KEY", "RouteColumns", "TapColumns"]
