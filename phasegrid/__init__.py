"""phasegrid: a Spark-native engine for stacks of unwrapped interferograms.

Python functions of this package are shipped to executors by value, so a
cluster needs the third-party libraries but no copy of the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
