"""Knowledge analytics on Spark: DataFrame operators for distilling, indexing, ranking and gating evidence.

The package's functions are shipped to executors by value, so a cluster needs no install of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
