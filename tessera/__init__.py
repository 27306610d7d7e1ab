"""Sparse linear algebra on Spark tables, re-expressed as joins and aggregations.

What runs in Python workers is pickled by value, so executors need no copy of the
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
