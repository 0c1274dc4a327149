"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get the functions of this subpackage by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
