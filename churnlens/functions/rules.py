"""Ordered rule lists (searched CASE) and the business labels built from them.

A rule list is ``[(predicate, label), ...]``; the first predicate that is
TRUE wins, NULL predicates fall through, no match gives ``default``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.functions.cache import lit
from churnlens.functions.keys import present

__all__ = [
    "case_when", "flag_key", "bundle_size", "bundle_name", "num_products",
    "tenure_segment", "plan_signature", "technology_flag",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case_when(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    if not rules:
        return F.lit(default)
    expr = None
    for pred, val in rules:
        v = val if isinstance(val, Column) else (lit(val) if val is not None else F.lit(None))
        expr = F.when(pred, v) if expr is None else expr.when(pred, v)
    if default is not None:
        expr = expr.otherwise(default if isinstance(default, Column) else F.lit(default))
    return expr


def flag_key(pred: Column, key) -> Column:
    """Flag that holds the account key itself (NULL when not flagged), so a
    ``count_distinct`` of the flag counts flagged accounts."""
    return F.when(pred, _c(key))


def num_products(vo, tv, bb) -> Column:
    return (present(vo).cast("int") + present(tv).cast("int") + present(bb).cast("int"))


def bundle_size(vo, tv, bb) -> Column:
    """3P / 2P / 1P / 0P. ``0P`` needs all three NULL; an all-empty row
    therefore is ``1P`` (kept on purpose, it is the reference's rule)."""
    vo, tv, bb = _c(vo), _c(tv), _c(bb)
    n = num_products(vo, tv, bb)
    return case_when([
        (n == 3, "3P"),
        (n == 2, "2P"),
        (vo.isNull() & tv.isNull() & bb.isNull(), "0P"),
    ], "1P")


def bundle_name(rgu_vo, rgu_tv, rgu_bb) -> Column:
    """Name of the product combination from 0/1 product flags."""
    v, t, b = _c(rgu_vo), _c(rgu_tv), _c(rgu_bb)
    return case_when([
        ((v == 1) & (t == 0) & (b == 0), "VO"),
        ((v == 0) & (t == 1) & (b == 0), "TV"),
        ((v == 0) & (t == 0) & (b == 1), "BB"),
        ((v == 1) & (t == 1) & (b == 0), "TV+VO"),
        ((v == 0) & (t == 1) & (b == 1), "BB+TV"),
        ((v == 1) & (t == 0) & (b == 1), "BB+VO"),
        ((v == 1) & (t == 1) & (b == 1), "BB+TV+VO"),
    ])


def tenure_segment(c, early: float = 6, mid: float | None = 12,
                   labels=("Early Tenure", "Mid Tenure", "Late Tenure"), strict: bool = False) -> Column:
    """Early / mid / late by cut points; ``mid=None`` gives early / late.
    ``strict`` uses ``<`` instead of ``<=`` for the cuts."""
    c = _c(c)
    le = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    rules = [(le(c, F.lit(early)), labels[0])]
    if mid is not None:
        rules.append((le(c, F.lit(mid)), labels[1]))
    rules.append((c.isNotNull(), labels[2]))
    return case_when(rules)


def plan_signature(vo, tv, bb, missing: str = "-") -> Column:
    return F.concat(F.coalesce(_c(vo), F.lit(missing)), F.coalesce(_c(tv), F.lit(missing)),
                    F.coalesce(_c(bb), F.lit(missing)))


def technology_flag(bb_name, tv_name, fibre_pattern: str = "%FTTH%",
                    fibre_tv: str = "NextGen TV", fibre: str = "FTTH", coax: str = "HFC") -> Column:
    bb, tv = _c(bb_name), _c(tv_name)
    return case_when([(bb.like(fibre_pattern) | ((tv == F.lit(fibre_tv)) & bb.isNull()), fibre)], coax)
