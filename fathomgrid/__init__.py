"""fathomgrid: a Spark-native engine for searching and linking trees of files.

Functions of this package that run in Spark's Python workers are shipped by
value, so that executors need no copy of the package on their own disks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
