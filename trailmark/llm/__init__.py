"""Operators for preparing language-model training data.

Nothing outside this package imports it. Functions that run on executors travel with the query, so the package need
not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
