"""loomql: relational, fuzzy and progressive analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their code: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
