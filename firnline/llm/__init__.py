"""Operators of a training-data pipeline: corpora, chats and vectors.

Functions that run inside tasks travel with the task, so executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
