"""Sensitivity of a repeated diagnostic test through time, as Spark jobs.

The moment of infection is never observed; it is integrated out over a grid of
incubation periods.  Every operator takes and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
