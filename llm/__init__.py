"""Operators for preparing training text, each written for tables of any size.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""

import sys

from pyspark import cloudpickle

# What runs in tasks travels with them, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
