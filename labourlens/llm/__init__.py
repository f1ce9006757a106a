"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

Nothing else in the library imports this package.  Its functions travel to the workers by value, so executors need only
the installed third-party libraries, not the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
