"""Operators that prepare training corpora. Nothing else in the library imports this subpackage.

Executors need no copy of it: functions sent to Python workers are pickled by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
