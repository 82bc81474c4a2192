"""Graph alignment analytics on Spark DataFrames.

Every table is keyed by ``doc_id`` (and ``component``, one of ``source`` and
``summary``); every operator is a function from DataFrames to DataFrames.
"""

import sys

from pyspark import cloudpickle

from weftgraph.settings import AlignSettings

# grouped functions travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["AlignSettings"]
