"""weft: a Spark-first engine for lossless column transforms, statistics and routing.

Functions that Spark sends to Python workers carry the package's code with them, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
