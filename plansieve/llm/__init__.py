"""Operators for preparing training data; nothing else in the library imports them."""

import os
import sys

from pyspark import cloudpickle

# Where workers cannot be expected to find this package, its functions travel with the job.
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and "site-packages" not in _ROOT:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
