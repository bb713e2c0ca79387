"""Event logs to weekly risk panels, scores and audits, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
