"""Ranking of multi-vector libraries from a few known positives, on Spark."""

import sys

from pyspark import cloudpickle

from .operators.whitening import fit_whitener, whiten
from .plans.scoring import score_library
from .schema import PUBLISHED, Params

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PUBLISHED", "Params", "fit_whitener", "score_library", "whiten"]
