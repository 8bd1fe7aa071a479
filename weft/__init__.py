"""weft: graph and corpus analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
