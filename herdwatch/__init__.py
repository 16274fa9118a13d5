"""Fleet telemetry, dataset lifecycle, snapshots, registry, access rules and settings on Spark."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions that run in tasks along with them, so that executors do not
# need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
