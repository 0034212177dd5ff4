"""Operators for preparing large text corpora (training data).

Ten operators, one module each, and ``queries`` with the registered
``opN_*`` queries. Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# the functions that run in tasks travel with them, so executors need no
# copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
