"""weftgraph: property-graph and relational analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
