"""Training-data operators: ten steps that prepare a text corpus for model training.

Nothing outside this subpackage imports it.  Functions that run on executors are
pickled by value, so that a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
