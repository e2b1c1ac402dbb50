"""Column functions.

The Arrow functions of this package are pickled by value, so executors need no
installed copy of it.
"""

from pyspark import cloudpickle

from . import html, stemming

for _module in (stemming, html):
    cloudpickle.register_pickle_by_value(_module)
