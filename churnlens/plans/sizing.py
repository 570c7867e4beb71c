"""Size checks before a broadcast.

A side is broadcast only when the optimizer's size estimate of its plan is
below a bound; otherwise the join stays a shuffle join. The estimate comes
from the logical plan statistics (file sizes for scans, propagated through
filters and projections), so the check costs no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BOUND = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    try:
        v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:  # pragma: no cover - no estimate available
        return 1 << 62
    return int(v) if isinstance(v, int) else int(v.toString())


def broadcast_if_small(df: DataFrame, bound: int = DEFAULT_BOUND) -> DataFrame:
    """``F.broadcast(df)`` when its estimated size is at most ``bound`` bytes."""
    return F.broadcast(df) if estimated_bytes(df) <= bound else df
