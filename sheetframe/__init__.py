"""sheetframe: worksheets, and text corpora, as Spark DataFrames.

Functions and classes of this package that run on executors travel inside the task (pickled by value),
so executors need nothing but PySpark, pyarrow and numpy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
