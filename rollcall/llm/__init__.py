"""Training-data operators: sharding, decontamination, mixing, line and suffix
dedup, chat formatting, fingerprints, URL filters, SimHash and toxicity.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel with the job, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
