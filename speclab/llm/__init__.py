"""Training-data operators: token counts, exact search, near-duplicates, sharding,
language identification, mixing, passage deduplication, page text, decontamination
and toxicity. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
