"""Training-data operators: media columns, fingerprints, joins, mixing, tokens, repeats,
classifiers, extraction and scans.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks carry these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
