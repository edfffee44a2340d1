"""Analytics over a corpus of source code, as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so nothing has to be
# installed on the worker nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
