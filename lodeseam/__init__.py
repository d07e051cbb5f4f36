"""Corpus retrieval, evidence packing and evaluation as Spark jobs.

Every public function takes and returns DataFrames; nothing here holds a global session.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
