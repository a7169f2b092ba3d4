"""treeloom: content-addressed tree analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
