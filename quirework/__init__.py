"""Document-page analytics on PySpark.

The package is pickled by value, so that its functions run on executors where
only PySpark and the libraries named in the README are installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
