"""Movements between opening and closing, tenure, spins and base reports
(D18-D26). Pure column expressions on the base: no shuffle of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.cache import col
from churnlens import labels as L
from churnlens.functions.rules import case_when, plan_signature, tenure_segment
from churnlens.params import Grain, Params


def full_periods(grain: Grain, start, end):
    """Whole periods elapsed (Presto ``date_diff`` on the period unit)."""
    s, e = col(start) if isinstance(start, str) else start, col(end) if isinstance(end, str) else end
    if grain.unit == "week":
        d = F.datediff(e.cast("date"), s.cast("date"))
        return (F.signum(d) * F.floor(F.abs(d) / 7)).cast("int")
    m = F.timestamp_diff("MONTH", s.cast("timestamp"), e.cast("timestamp"))
    if grain.unit == "month":
        return m.cast("int")
    k = 3 if grain.unit == "quarter" else 12
    return (F.signum(m) * F.floor(F.abs(m) / k)).cast("int")


def main_movement(base: DataFrame, params: Params = Params(), variant: str = "presto") -> DataFrame:
    """Movement label per (account, period) (D19) and the RGU difference.

    ``presto`` (default): same / upsell / downsell; come back to life when a
    new closing account started in another period and was installed at most
    one full period before; new when it started at most one period before;
    loss; missing customer. ``bigquery``: come back when the start period
    differs, new when equal, then loss.
    """
    g = params.grain
    b, e = col("b_num_rgus"), col("e_num_rgus")
    m = col("fixed_month")
    diff = e - b
    start_p = g.trunc(col("e_act_cust_strt_dt").cast("date"))
    newcomer = b.isNull() & (e > 0)
    rules = [(diff == 0, L.MM_SAME), (diff > 0, L.MM_UPSELL), (diff < 0, L.MM_DOWNSELL)]
    if variant == "presto":
        rules += [
            (newcomer & (start_p != m) & (full_periods(g, "e_max_inst", m) <= 1), L.MM_COMEBACK),
            (newcomer & (full_periods(g, "e_act_cust_strt_dt", m) <= 1), L.MM_NEW),
            ((col("active_bom") == 1) & (col("active_eom") == 0), L.MM_LOSS),
            (newcomer & (start_p != m), L.MM_MISSING),
        ]
    else:
        rules += [
            (newcomer & (start_p != m), L.MM_COMEBACK),
            (newcomer & (start_p == m), L.MM_NEW),
            ((col("active_bom") == 1) & (col("active_eom") == 0), L.MM_LOSS),
        ]
    return base.withColumns({"main_movement": case_when(rules), "dif_total_rgu": diff})


def spin_movement(df: DataFrame, parity: bool = False) -> DataFrame:
    """Bill up or down with the same products (D21). ``parity`` reproduces
    the Presto test against the uncoded label, which never matches."""
    same = col("main_movement") == F.lit("Same RGUs" if parity else L.MM_SAME)
    d = col("e_bill_amt") - col("b_bill_amt")
    return df.withColumn("spin_movement", case_when([(same & (d > 0), L.SPIN_UP), (same & (d < 0), L.SPIN_DOWN)],
                                                    L.SPIN_NONE))


def tenure_segments(df: DataFrame, params: Params = Params(), prefix: str = "fixed") -> DataFrame:
    """Early / mid / late tenure at opening and closing."""
    return df.withColumns({
        f"b_{prefix}_tenure_segment": tenure_segment("b_tenure", params.tenure_early, params.tenure_mid),
        f"e_{prefix}_tenure_segment": tenure_segment("e_tenure", params.tenure_early, params.tenure_mid),
    })


def gain_movement(df: DataFrame, params: Params = Params(), install: str = "e_max_inst") -> DataFrame:
    """Kind of gain and change per product between opening and closing.

    An account that only closes the period is a gross add when its install
    (``install``; the sources take the last or the first one) lies in the
    period and a comeback when it does not. A product's change is 0 for an
    account that lacks one of the two sides, as in the source."""
    gained = (col("active_bom") == 0) & (col("active_eom") == 1)
    period = params.grain.trunc(col(install).cast("date"))
    out = {"gain_movement": case_when([(gained & (period == col("fixed_month")), L.GAIN_NEW),
                                       (gained & (period != col("fixed_month")), L.GAIN_COMEBACK)])}
    for p in ("vo", "tv", "bb"):
        out[f"dif_rgu_{p}"] = F.coalesce(col(f"e_rgu_{p}") - col(f"b_rgu_{p}"), F.lit(0))
    return df.withColumns(out)


def rgu_movement_report(base: DataFrame, max_overdue: int = 90) -> DataFrame:
    """Customers, opening and closing products and product changes per
    period, movement and kind of gain (D20, D24), of ``main_movement`` and
    ``gain_movement`` output. Accounts that close beyond ``max_overdue`` are
    left out of the product totals (not of the customers)."""
    within = (col("e_overdue") <= max_overdue) | col("e_overdue").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(within, col(c))), F.lit(0)).cast("long")
    per = base.groupBy("fixed_month", "main_movement", "gain_movement")
    return per.agg(F.count_distinct("fixed_account").alias("customers"),
                   *[total(f"{s}_rgu_{p}").alias(f"{n}_{p}") for s, n in (("b", "opening"), ("e", "closing")) for p in ("vo", "tv", "bb")],
                   *[F.sum(f"dif_rgu_{p}").cast("long").alias(f"change_{p}") for p in ("vo", "tv", "bb")],
                   F.coalesce(F.sum("dif_total_rgu"), F.lit(0)).cast("long").alias("change_total"))


def with_plans(df: DataFrame) -> DataFrame:
    """Plan signatures at opening and closing."""
    return df.withColumns({
        "b_plan": plan_signature("b_vo_nm", "b_tv_nm", "b_bb_nm"),
        "e_plan": plan_signature("e_vo_nm", "e_tv_nm", "e_bb_nm"),
    })


def movement_report(base: DataFrame) -> DataFrame:
    """Opening/closing customers and RGUs by period and movement.
    One partial aggregation per task, then a small shuffle by group."""
    return (base.groupBy("fixed_month", "main_movement")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_distinct("fixed_account").alias("n_accounts"),
                 F.sum("active_bom").cast("long").alias("bom_accounts"),
                 F.sum("active_eom").cast("long").alias("eom_accounts"),
                 F.sum(F.coalesce("b_num_rgus", F.lit(0))).cast("long").alias("bom_rgus"),
                 F.sum(F.coalesce("e_num_rgus", F.lit(0))).cast("long").alias("eom_rgus")))


def gross_adds(snap: DataFrame, params: Params = Params(), key: str = "act_acct_cd", day: str = "dt",
               start: str = "act_cust_strt_dt", age: str = "fi_outst_age", max_age: int = 90,
               products=(("vo", "pd_vo_prod_nm", "fi_vo_mrc_amt"), ("bb", "pd_bb_prod_nm", "fi_bb_mrc_amt"),
                         ("tv", "pd_tv_prod_nm", "fi_tv_mrc_amt"))) -> DataFrame:
    """Accounts on the last day of a period that started in it (D25): plan
    rows, products and product revenue per period.

    A plan row is an account's distinct combination of products on that day
    with its mean charges; accounts without a product or overdue beyond
    ``max_age`` do not count. The day is a filter, so one scan and one
    aggregate per account suffice."""
    g = params.grain
    d = col(day).cast("date")
    last = F.date_sub(g.shift(g.trunc(d), 1), 1)
    has = {n: F.coalesce(col(name) != "", F.lit(False)) for n, name, _ in products}
    some = F.lit(False)
    for h in has.values():
        some = some | h
    rows = snap.where((d == last) & some & ((col(age) <= max_age) | col(age).isNull()))
    plans = rows.groupBy(key, g.trunc(d).alias("month"), *[name for _, name, _ in products]).agg(
        F.min(col(start).cast("date")).alias("_start"), *[F.avg(amt).alias(f"_{n}") for n, _, amt in products])
    new = plans.where(col("_start") >= col("month"))
    return new.groupBy("month").agg(
        F.count(F.lit(1)).alias("gross_adds"), *[F.sum(has[n].cast("int")).cast("long").alias(f"gross_adds_{n}") for n, _, _ in products],
        *[F.round(F.sum(f"_{n}"), 0).alias(f"revenue_{n}") for n, _, _ in products])


def user_base(base: DataFrame, by=("fixed_month", "e_mix", "e_fixed_tenure_segment", "e_tech_flag")) -> DataFrame:
    """Closing users by bundle size, tenure and technology."""
    return (base.where(col("active_eom") == 1).groupBy(*by)
            .agg(F.count_distinct("fixed_account").alias("users")))


def mobile_movement(df: DataFrame, params: Params = Params(), variant: str = "bigquery") -> DataFrame:
    """Mobile line movement (D22): maintain / down-spin / up-spin when active
    at both ends, loss, come back or new (``bigquery`` only), MRC gap."""
    g = params.grain
    b, e = col("b_mobile_mrc"), col("e_mobile_mrc")
    ab, ae = col("mobile_active_bom"), col("mobile_active_eom")
    both = (ab == 1) & (ae == 1)
    rules = [(both & (b == e), L.MOB_MAINTAIN), (both & (b > e), L.MOB_DOWNSPIN),
             (both & (b < e), L.MOB_UPSPIN), ((ab == 1) & (ae == 0), L.MOB_LOSS)]
    if variant == "bigquery":
        newly = ((ab == 0) | ab.isNull()) & (ae == 1)
        sp = g.trunc(col("e_start_date"))
        rules += [(newly & (sp != col("mobile_month")), L.MOB_COMEBACK),
                  (newly & (sp == col("mobile_month")), L.MOB_NEW)]
    rules.append((b.isNull() | e.isNull(), L.MOB_GAP))
    return df.withColumn("mobile_movement_flag", case_when(rules))
