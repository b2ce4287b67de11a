"""Operators for preparing training data; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Python workers get these functions with the task, however the session was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
