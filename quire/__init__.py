"""quire: a bibliographic catalog engine and text-corpus toolkit on PySpark.

Functions that run inside executors are shipped by value, so a cluster needs no
copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
