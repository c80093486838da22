"""Property-listing analytics as Spark jobs: tables in, tables out."""

import sys

from pyspark import cloudpickle

# The few Python functions of this package travel to the workers with the query, so a cluster needs no install of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
