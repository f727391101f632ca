"""A versioned key-value engine on Spark: changelog, reconciled view, generations, compaction, streaming ingest.

Functions that run in Python workers are pickled by value, so executors need no
copy of the package.
"""
import sys

from pyspark import cloudpickle

from .model import CorruptStore, InvalidArgument, Options  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[__name__])
