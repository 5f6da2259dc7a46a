"""Retrieval analytics over multimodal embeddings, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Tile kernels and Arrow helpers run inside Python workers.  Shipping this
# package by value keeps executors free of any install step.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
