"""Parameters and period grain (thresholds and the period in one place).

The reference keeps thresholds in a one-row parameter CTE and hard-codes
months the authors marked for parametrisation; here they are plain values.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grain:
    """Reporting period: ``month`` (default), ``quarter``, ``year`` or ``week``.

    ``trunc`` maps a date to the first day of its period, ``shift`` moves a
    period start by ``n`` periods. Both are plain date expressions, so a
    filter on them stays inside whole-stage codegen.
    """

    unit: str = "month"

    def trunc(self, c: Column) -> Column:
        if self.unit == "month":
            return F.trunc(c, "MM")
        if self.unit == "quarter":
            return F.trunc(c, "QUARTER")
        if self.unit == "year":
            return F.trunc(c, "YEAR")
        if self.unit == "week":
            return F.trunc(c, "week")  # ISO week, Monday
        raise ValueError(self.unit)

    def shift(self, c: Column, n: int) -> Column:
        if n == 0:
            return c
        if self.unit == "month":
            return F.add_months(c, n)
        if self.unit == "quarter":
            return F.add_months(c, 3 * n)
        if self.unit == "year":
            return F.add_months(c, 12 * n)
        if self.unit == "week":
            return F.date_add(c, 7 * n)
        raise ValueError(self.unit)

    def periods_covering(self, start: Column, end: Column) -> Column:
        """Array of the period starts from ``start``'s period to ``end``'s."""
        step = {"month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR",
                "week": "INTERVAL 7 DAYS"}[self.unit]
        return F.sequence(self.trunc(start), self.trunc(end), F.expr(step))

    def periods_between(self, start: Column, end: Column) -> Column:
        """Number of period boundaries crossed from ``start`` to ``end``."""
        s, e = self.trunc(start), self.trunc(end)
        if self.unit == "week":
            return F.floor(F.datediff(e, s) / 7).cast("int")
        months = (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)
        if self.unit == "month":
            return months.cast("int")
        if self.unit == "quarter":
            return F.floor(months / 3).cast("int")
        return F.floor(months / 12).cast("int")


@dataclass(frozen=True)
class Params:
    """Business thresholds. Defaults are the reference's values."""

    grain: Grain = field(default_factory=Grain)
    # Involuntary churn: overdue age that means disconnection.
    invol_days: int = 90
    # Opening snapshot keeps overdue <= bom_max_overdue, closing < eom_max_overdue.
    bom_max_overdue: int | None = 90
    eom_max_overdue: int | None = 90
    # Tenure cut points (in the unit of the tenure column): <= early, <= mid.
    tenure_early: int = 6
    tenure_mid: int = 12
    # Overdue repair: a jump larger than this against both neighbours is a spike.
    spike_gap: int = 2
    # Drivers.
    soft_dx_days: int = 26
    never_paid_days: int = 90
    early_contact_days: int = 21
    early_ticket_weeks: int = 7
    bill_shock_pct: float = 0.05
    outlier_install_days: int = 6
    contact_window_days: int = 60
    ftr_days: int = 14
    # Rejoiner window in periods.
    rejoiner_periods: int = 4
    # Churn by service order: last snapshot at most this many periods after the order.
    churn_order_periods: int = 1
    # Average-MRC activity rule.
    young_account_days: int = 60

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)
