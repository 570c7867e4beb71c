"""churnlens: subscriber analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark's own
joins, windows and aggregates. Thresholds, labels and the period grain are
parameters (``churnlens.params``).
"""

from churnlens.params import Grain, Params
from churnlens.session import get_session

__all__ = ["Grain", "Params", "get_session"]
