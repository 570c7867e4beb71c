"""Reuse of immutable Column objects.

Every ``F.col``/``F.lit`` is a round trip to the JVM. The rule chains use the
same columns and labels hundreds of times, and Column objects are immutable,
so they are built once per SparkContext and reused.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_cache: dict = {}
_owner: list = [None]


def _store() -> dict:
    sc = SparkContext._active_spark_context
    if _owner[0] is not sc:
        _cache.clear()
        _owner[0] = sc
    return _cache


def col(name: str) -> Column:
    s = _store()
    k = ("c", name)
    if k not in s:
        s[k] = F.col(name)
    return s[k]


def lit(value) -> Column:
    s = _store()
    k = ("l", type(value).__name__, value)
    if k not in s:
        s[k] = F.lit(value)
    return s[k]


def memo(key, build) -> Column:
    """Cache any Column built from hashable ``key``."""
    s = _store()
    k = ("m", key)
    if k not in s:
        s[k] = build()
    return s[k]
