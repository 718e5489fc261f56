"""See the package README.

Stateful operators are pickled by value, so executors need no installed copy.
"""
import sys

from pyspark import cloudpickle

from .. import params

for _module in (sys.modules[__name__], params):
    cloudpickle.register_pickle_by_value(_module)
