"""Training-data operators: filtering, deduplication, extraction, search, mixing and packing of documents.

Nothing else in the library imports this subpackage; it takes only general helpers from the library.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
