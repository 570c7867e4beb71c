"""Fixed and mobile churn, rejoiners.

The reference builds involuntary churn from four CTEs joined back together
(first record below the limit, last record, overdue on the last day, the
last raw age). All of them are facts about one (account, period), so here
they are one ``groupBy(account, period)`` with conditional aggregates and
``max_by``: one partial aggregation per task and one shuffle, no self-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.cache import col
from churnlens import labels as L
from churnlens.functions.keys import pad_key
from churnlens.functions.rules import case_when, tenure_segment
from churnlens.params import Params

KEY = "act_acct_cd"
DAY = "dt"


def voluntary_churn(base: DataFrame) -> DataFrame:
    """Accounts active at opening and absent at closing (D30), once each however many plan rows they have."""
    return (base.where((col("active_bom") == 1) & ((col("active_eom") == 0) | col("active_eom").isNull()))
                .select("fixed_month", "fixed_account").distinct().withColumn("vol_churner", F.lit(L.FIXED_VOL)))


def initial_rgus(snap: DataFrame, key: str = KEY, day: str = DAY) -> DataFrame:
    """Number of products on the account's first record (D31); an aggregate
    (``min_by``) instead of a window, so it combines map-side."""
    first = F.min_by(F.struct("pd_vo_prod_nm", "pd_bb_prod_nm", "pd_tv_prod_nm"), col(day))
    return (snap.groupBy(key).agg(first.alias("_f"))
                .select(col(key),
                        (col("_f.pd_vo_prod_nm").isNotNull().cast("int")
                         + col("_f.pd_bb_prod_nm").isNotNull().cast("int")
                         + col("_f.pd_tv_prod_nm").isNotNull().cast("int")).alias("max_rgus_count")))


def period_facts(repaired: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY) -> DataFrame:
    """One row per (account, period): whether some record is below the
    involuntary limit, the repaired and raw age on the last record, the
    products seen in the period and the days from the last install to the
    last record. Input: ``repair_overdue`` output with ``month`` and
    ``max_inst`` (``snapshot_features``)."""
    lim = params.invol_days
    last = F.max_by(F.struct(col("mora_fix").alias("fix"), col("fi_outst_age").alias("raw"),
                             col(day).alias("d")), col(day))
    return (repaired.groupBy(key, "month").agg(
        F.max((col("mora_fix") < lim).cast("int")).alias("any_below"),
        last.alias("_last"),
        F.max(col("pd_vo_prod_nm").isNotNull().cast("int")).alias("_vo"),
        F.max(col("pd_bb_prod_nm").isNotNull().cast("int")).alias("_bb"),
        F.max(col("pd_tv_prod_nm").isNotNull().cast("int")).alias("_tv"),
        F.max("max_inst").alias("_max_inst"),
    ).select(
        col(key), col("month"), col("any_below"),
        col("_last.fix").alias("last_mora_fix"), col("_last.raw").alias("last_overdue"),
        col("_last.d").alias("last_record"),
        (col("_vo") + col("_bb") + col("_tv")).alias("invol_rgu_churn"),
        F.datediff(col("_last.d"), col("_max_inst").cast("date")).alias("churn_tenure_days"),
    ))


def involuntary_churn(facts: DataFrame, params: Params = Params(), key: str = KEY) -> DataFrame:
    """Below the limit at some point of the period and at or above it on the
    last record, both repaired and raw (D32, D33)."""
    lim = params.invol_days
    return (facts.where((col("any_below") == 1) & (col("last_mora_fix") >= lim) & (col("last_overdue") >= lim))
                 .select(col("month"), col(key).alias("churn_account"), F.lit(L.FIXED_INVOL).alias("invol_churner"),
                         "invol_rgu_churn", "churn_tenure_days"))


def involuntary_by_end_records(daily: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY,
                               age: str = "fi_outst_age", install: str = "max_inst") -> DataFrame:
    """Within the limit on the period's first record and at or above it on
    its last one, by raw ages (D32, first-record form), with the days from the
    install to the last record. Of several rows on one day the smallest known
    age of the first day and the largest of the last one decide, as the source
    asks for any row. One aggregate instead of two joins back to the daily rows."""
    lim = params.invol_days
    d = col(day).cast("date")
    per = daily.where(col(key).isNotNull()).groupBy(key, params.grain.trunc(d).alias("month")).agg(
        F.min(F.struct(d.alias("d"), col(age).isNull().alias("no"), col(age).alias("age"))).alias("_f"),
        F.max(F.struct(d.alias("d"), col(age).alias("age"))).alias("_l"), F.max(col(install).cast("date")).alias("_inst"))
    return per.where((col("_f.age") <= lim) & (col("_l.age") >= lim)).select(
        "month", col(key).alias("churn_account"), F.lit(L.FIXED_INVOL).alias("churner_type"),
        F.datediff(col("_l.d"), col("_inst")).alias("churn_tenure_days"))


def churn_flags(base: DataFrame, churners: DataFrame, late_after: int = 180) -> DataFrame:
    """Base rows with churn flag, churn type, days of tenure at churn and its
    segment (D41); ``churners`` holds (month, churn_account, churner_type,
    churn_tenure_days). An account with two types has two rows, as in the source."""
    c = churners.select(col("month").alias("_cm"), col("churn_account").alias("_ca"), "churner_type", "churn_tenure_days").distinct()
    j = base.join(c, (col("fixed_month") == col("_cm")) & (col("fixed_account") == col("_ca")), "left")
    found, days = col("_ca").isNotNull(), col("churn_tenure_days")
    return j.withColumns({
        "fixed_churn_flag": F.when(found, F.lit("1. Fixed Churner")).otherwise(F.lit("2. Non-churner")),
        "fixed_churn_type_flag": F.when(found, col("churner_type")).otherwise(F.lit("2.Non-Churners")),
        "churn_tenure_segment": F.when(days <= late_after, F.lit("0.Early-tenure Churner")).when(
            days > late_after, F.lit("1.Late-tenure Churner")).otherwise(F.lit("2.Non-Churner"))}).drop("_cm", "_ca", "churner_type")


def churners_by_deinstallation(base: DataFrame, orders: DataFrame, invol: DataFrame, params: Params = Params(),
                               exclude_status=()) -> DataFrame:
    """Voluntary churners are lost accounts with an uninstall order of at most
    one period before (or of any later one); they are full-joined to the
    involuntary ones (month, churn_account) on the order's period, and the
    voluntary type wins (D34, earlier form). Distinct (month, account, type)."""
    g = params.grain
    lost = voluntary_churn(base).select("fixed_month", "fixed_account")
    o = _uninstalls(orders, exclude_status).select(col("account_name").alias("_oa"), g.trunc(col("order_start_date")).alias("_om")).distinct()
    v = lost.join(o, (col("fixed_account") == col("_oa")) & (g.periods_between(col("_om"), col("fixed_month")) <= 1))
    i = invol.select(col("month").alias("_im"), col("churn_account").alias("_ia")).distinct()
    j = v.join(i, (col("_om") == col("_im")) & (col("_oa") == col("_ia")), "full")
    return j.select(F.coalesce("fixed_month", "_im").alias("churn_month"), F.coalesce("fixed_account", "_ia").alias("churn_account"),
                    F.when(col("fixed_account").isNotNull(), F.lit(L.FIXED_VOL)).otherwise(F.lit(L.FIXED_INVOL)).alias("fixed_churner_type")).distinct()


def merge_churners(vol: DataFrame, invol: DataFrame, max_rgus: DataFrame, key: str = KEY) -> DataFrame:
    """Full join of voluntary and involuntary churners; involuntary wins."""
    v = (vol.join(max_rgus.withColumnRenamed(key, "fixed_account"), "fixed_account", "left")
            .withColumnRenamed("fixed_month", "_vm").withColumnRenamed("fixed_account", "_va"))
    i = invol.withColumnRenamed("month", "_im").withColumnRenamed("churn_account", "_ia")
    j = v.join(i, (col("_vm") == col("_im")) & (col("_va") == col("_ia")), "full")
    return j.select(
        F.coalesce("_im", "_vm").alias("churn_month"),
        F.coalesce("_ia", "_va").alias("churn_account"),
        F.coalesce("invol_churner", "vol_churner").alias("fixed_churner_type"),
        "invol_rgu_churn", "max_rgus_count", "churn_tenure_days",
    )


def attach_churn(base: DataFrame, churners: DataFrame) -> DataFrame:
    """Left join churners to the base; an account active at closing is no churner."""
    c = churners.withColumnRenamed("fixed_churner_type", "_type")
    j = base.join(c, (col("fixed_month") == col("churn_month")) & (col("fixed_account") == col("churn_account")),
                  "left")
    return j.withColumn("fixed_churner_type", F.when(col("active_eom") == 1, F.lit(None).cast("string"))
                        .otherwise(col("_type"))).drop("_type", "churn_month", "churn_account")


def churn_tenure(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Days from the last install to churn and a segment."""
    return df.withColumn("churn_tenure_segment",
                         tenure_segment("churn_tenure_days", params.tenure_early, params.tenure_mid))


def rejoiners(table: DataFrame, repaired: DataFrame, params: Params = Params(), key: str = KEY,
              day: str = DAY) -> DataFrame:
    """Churners of period p that are active again in p + 1 (overdue within
    the limit, or nothing overdue and a payment in that period); the type
    follows the churn type (D52). ``repaired`` holds daily rows with
    ``mora_fix`` and ``month``; ``rejoiners_from_summary`` reads the same
    activity from the period summary."""
    g = params.grain
    active = (repaired.where((col("mora_fix") <= params.invol_days)
                             | (col("mora_fix").isNull() & (g.trunc(col("lst_pymt_dt").cast("date")) == col("month"))))
                      .select(col(key).alias("exit_account"), col("month").alias("rejoiner_month")).distinct())
    return _attach_rejoiners(table, active, params)


def fixed_rgu_churn(df: DataFrame) -> DataFrame:
    """Products lost: involuntary -> products of the period, voluntary ->
    products on the first record, downsell -> the difference (D42)."""
    t = col("fixed_churner_type")
    return df.withColumn("fixed_rgu_churn", case_when([
        (t == L.FIXED_INVOL, col("invol_rgu_churn")),
        (t == L.FIXED_VOL, col("max_rgus_count")),
        (col("main_movement") == L.MM_DOWNSELL, col("b_num_rgus") - col("e_num_rgus")),
    ], F.lit(0)))


def churn_counts(table: DataFrame, month: str = "fixed_month", type_col: str = "fixed_churner_type",
                 account: str = "fixed_account", rgus: str = "fixed_rgu_churn") -> DataFrame:
    """Churners by period and type, with the sum of lost products (D124)."""
    return (table.where(col(type_col).isNotNull()).groupBy(month, type_col)
                 .agg(F.count_distinct(account).alias("churners"),
                      F.sum(F.coalesce(col(rgus), F.lit(0))).cast("long").alias("rgus_lost")))


def _exits(base: DataFrame, account: str = "fixed_account", month: str = "fixed_month") -> DataFrame:
    return (base.where((col("active_bom") == 1) & (col("active_eom") == 0))
                .select(col(account).alias("_xa"), col(month).alias("_xm"), col("b_num_rgus").alias("_xr")))


def rejoiner_window(base: DataFrame, params: Params = Params(), periods: int = 1,
                    account: str = "fixed_account", month: str = "fixed_month") -> DataFrame:
    """Rejoiners by period p (D53): accounts lost in an earlier period x whose
    re-entry period x + 1 lies in [p, p + ``periods``], and whose movement in
    p is 'come back to life'. Each exit is expanded to its ``periods`` + 1
    target periods (a bounded array, no pairing), then equi-joined."""
    g = params.grain
    ex = _exits(base, account, month)
    targets = F.array(*[g.shift(col("_xm"), 1 - k) for k in range(periods + 1)])
    pop = (ex.select("_xa", "_xm", F.explode(targets).alias("_p")).where(col("_p") != col("_xm"))
             .select("_xa", "_p").distinct())
    j = base.join(pop, (col(account) == col("_xa")) & (col(month) == col("_p")), "left")
    in_pop = col("_xa").isNotNull()
    rej = in_pop & (col("main_movement") == L.MM_COMEBACK)
    return (j.groupBy(month).agg(F.count_distinct(F.when(in_pop, col(account))).alias("rejoiner_population"),
                                 F.count_distinct(F.when(rej, col(account))).alias("rejoiners")))


def rejoiner_pool(base: DataFrame, params: Params = Params(), periods: int | None = None,
                  account: str = "fixed_account", month: str = "fixed_month") -> DataFrame:
    """Potential rejoiners of period p (D54): accounts lost in x with
    x <= p <= x + ``periods``; one row per (account, p) with the products
    held at the exit."""
    g = params.grain
    n = params.rejoiner_periods if periods is None else periods
    ex = _exits(base, account, month)
    targets = F.array(*[g.shift(col("_xm"), k) for k in range(n + 1)])
    return (ex.select("_xa", "_xr", F.explode(targets).alias("_p"))
              .groupBy(col("_xa").alias("account"), col("_p").alias("month"))
              .agg(F.max("_xr").alias("exit_rgus")))


def rejoiner_population(pool: DataFrame) -> DataFrame:
    """Size of the pool and its products per period."""
    return pool.groupBy("month").agg(F.count(F.lit(1)).alias("pool_accounts"),
                                     F.sum(F.coalesce("exit_rgus", F.lit(0))).cast("long").alias("pool_rgus"))


def effective_rejoiners(pool: DataFrame, base: DataFrame, params: Params = Params(),
                        account: str = "fixed_account", month: str = "fixed_month") -> DataFrame:
    """Pool members of p that are in the closing base of p and were not in
    the closing base of p - 1 (D55)."""
    g = params.grain
    closing = base.where(col("active_eom") == 1).select(col(account).alias("account"), col(month).alias("month"))
    prev = closing.select("account", g.shift(col("month"), 1).alias("month"))
    eff = pool.select("account", "month").join(closing, ["account", "month"], "inner") \
              .join(prev, ["account", "month"], "left_anti")
    return eff.groupBy("month").agg(F.count_distinct("account").alias("effective_rejoiners"))


def _uninstalls(orders: DataFrame, exclude_status=()) -> DataFrame:
    """Uninstall orders with a status. The reference's filter
    ``status <> 'CANCELADA' OR status <> 'ANULADA'`` keeps every non-null
    status; ``exclude_status`` applies the intended exclusion instead."""
    u = orders.where((col("order_type") == L.ORDER_UNINSTALL) & col("order_status").isNotNull())
    if exclude_status:
        u = u.where(~col("order_status").isin(list(exclude_status)))
    return u


def _order_type(reason) -> "F.Column":
    return F.when(reason == L.ORDER_REASON_INVOL, F.lit(L.FIXED_INVOL)).when(reason.isNotNull(), F.lit(L.FIXED_VOL))


def churn_by_order(orders: DataFrame, snap: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY,
                   exclude_status=()) -> DataFrame:
    """Churn from the account's last uninstall order (D35): reason
    ``MOROSIDAD`` is involuntary, other given reasons voluntary, an account
    whose order has none is no churner; it counts only when the
    account's last snapshot is at most ``churn_order_periods`` periods after
    the order. Both sides are reduced to one row per account first and meet on
    the padded key; ``account`` is the snapshot's, and accounts of one padded
    key share their last snapshot."""
    g = params.grain
    u = _uninstalls(orders, exclude_status)
    last = u.groupBy(pad_key("account_name").alias("_key")).agg(
        F.max_by(F.struct(col("order_start_date").alias("d"), col("order_reason").alias("r")),
                 F.struct("order_start_date", "order_id")).alias("_o"))
    ls = snap.groupBy(col(key).alias("account")).agg(F.max(day).alias("last_snapshot")).withColumn("_key", pad_key("account"))
    ls = ls.withColumn("last_snapshot", F.max("last_snapshot").over(Window.partitionBy("_key")))
    j = last.join(ls, "_key", "inner").where(
        g.periods_between(col("_o.d"), col("last_snapshot")) <= params.churn_order_periods)
    j = j.where(col("_o.r").isNotNull())
    return j.select("account", g.trunc(col("_o.d")).alias("churn_month"), _order_type(col("_o.r")).alias("churn_type"))


def churn_by_first_order(orders: DataFrame, params: Params = Params(), exclude_status=()) -> DataFrame:
    """Type of the account's first uninstall order."""
    g = params.grain
    first = _uninstalls(orders, exclude_status).groupBy(col("account_name").alias("account")).agg(
        F.min_by(F.struct(col("order_start_date").alias("d"), col("order_reason").alias("r")),
                 F.struct("order_start_date", "order_id")).alias("_o"))
    return first.select("account", g.trunc(col("_o.d")).alias("first_order_month"),
                        _order_type(col("_o.r")).alias("churn_type"))


def churn_by_order_type(base: DataFrame, orders: DataFrame, params: Params = Params(),
                        vol_label: str = "V_DISCO", invol_label: str = "NON PAY") -> DataFrame:
    """Attach the period's disconnection orders to the base (D40): an
    involuntary reason is ``NON PAY``, any other ``V_DISCO``; with both in
    one period the involuntary wins."""
    g = params.grain
    u = _uninstalls(orders)
    t = F.when(col("order_reason") == L.ORDER_REASON_INVOL, F.lit(invol_label)).otherwise(F.lit(vol_label))
    per = (u.groupBy(col("account_name").alias("_oa"), g.trunc(col("order_start_date")).alias("_om"))
            .agg(F.max(F.when(t == invol_label, 1).otherwise(0)).alias("_inv")))
    j = base.join(per, (col("fixed_account") == col("_oa")) & (col("fixed_month") == col("_om")), "left")
    return j.withColumn("order_churn_type", F.when(col("_inv") == 1, F.lit(invol_label))
                        .when(col("_inv") == 0, F.lit(vol_label))).drop("_oa", "_om", "_inv")


def voluntary_counts(orders: DataFrame) -> DataFrame:
    """Voluntary disconnection lines by day."""
    u = _uninstalls(orders).where(col("order_reason") != L.ORDER_REASON_INVOL)
    return u.groupBy(col("order_start_date").alias("day")).agg(F.count(F.lit(1)).alias("voluntary_lines"))


def match_churn_order(crm: DataFrame, orders: DataFrame, params: Params = Params(), periods: int = 3,
                      account: str = "account", churn_date: str = "churn_date") -> DataFrame:
    """CRM churn date matched to the latest uninstall order at most
    ``periods`` periods before it (D37).

    As-of match without pairs: orders and churn dates, one row per account and
    day each, stand in one sequence per account, and a running maximum carries
    the latest order to each churn date. The cost is one sort of the days,
    however many orders an account has."""
    g = params.grain
    order = F.struct("order_start_date", "order_id", "order_reason")
    u = _uninstalls(orders).where(col("order_start_date").isNotNull()).groupBy(
        col("account_name").alias(account), col("order_start_date").cast("date").alias("_day")).agg(F.max(order).alias("_o"))
    c = crm.select(account, col(churn_date).cast("date").alias("_day"), col(churn_date)).where(col("_day").isNotNull()).distinct()
    events = u.unionByName(c, allowMissingColumns=True)
    upto = Window.partitionBy(account).orderBy("_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    j = events.where(col(account).isNotNull()).withColumn("_last", F.max("_o").over(upto)).where(
        col(churn_date).isNotNull() & (col("_last.order_start_date") >= g.shift(col("_day"), -periods)))
    return j.select(account, churn_date, col("_last.order_id").alias("order_id"), col("_last.order_start_date").alias("order_date"),
                    _order_type(col("_last.order_reason")).alias("churn_type"))


def voluntary_by_lines(cancels: DataFrame, snap: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY,
                       cancel_key: str = "src_account_id", cancel_day: str = "cancel_date") -> DataFrame:
    """Voluntary churners by reconciling cancelled lines (D38): the lines
    cancelled on the account's last cancel date equal the products on its
    last snapshot; an overdue age at or above ``invol_days`` on that record
    makes it a mixed churner. Both sides are reduced to one row per account
    with aggregates before the join."""
    last_day = cancels.groupBy(col(cancel_key).alias("account")).agg(F.max(cancel_day).alias("last_cancel"))
    lines = (cancels.select(col(cancel_key).alias("account"), col(cancel_day).alias("last_cancel"))
                    .join(last_day, ["account", "last_cancel"], "inner")
                    .groupBy("account", "last_cancel").agg(F.count(F.lit(1)).alias("cancelled_lines")))
    nprod = (col("pd_vo_prod_nm").isNotNull().cast("int") + col("pd_tv_prod_nm").isNotNull().cast("int")
             + col("pd_bb_prod_nm").isNotNull().cast("int"))
    last = snap.groupBy(col(key).alias("account")).agg(
        F.max_by(F.struct(nprod.alias("n"), col("fi_outst_age").alias("age"), col(day).alias("d")),
                 col(day)).alias("_l"))
    j = lines.join(last, "account", "inner").where(col("cancelled_lines") == col("_l.n"))
    return j.select("account", "last_cancel", "cancelled_lines", col("_l.d").alias("last_record"),
                    F.when(col("_l.age") >= params.invol_days, F.lit("2.Fixed Mixed Churner"))
                     .otherwise(F.lit("1.Fixed Voluntary Churner")).alias("churn_type"))


def churn_by_crm(snap: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY,
                 churn_col: str = "cst_chrn_dt", bb_days: int = 60, other_days: int | None = None,
                 early_days: int = 180) -> DataFrame:
    """Churners by the CRM churn date (D39), one ``groupBy`` per account.

    An account is a churner when its last churn date falls in the period of
    its last snapshot; involuntary when some record with a broadband product
    is ``bb_days`` or more overdue, or one with TV/voice ``other_days`` or
    more, on or before the last churn date; tenure early when the highest
    customer age is at most ``early_days``."""
    g = params.grain
    od = params.invol_days if other_days is None else other_days
    age = col("fi_outst_age")
    invol_row = ((age >= bb_days) & col("pd_bb_prod_nm").isNotNull()) | (
        (age >= od) & (col("pd_tv_prod_nm").isNotNull() | col("pd_vo_prod_nm").isNotNull()))
    per = snap.groupBy(col(key).alias("account")).agg(
        F.max(churn_col).alias("last_churn"), F.min(churn_col).alias("first_churn"), F.max(day).alias("_last_snap"),
        F.min(F.when(invol_row, col(churn_col))).alias("_invol_churn"), F.max("c_cust_age").alias("_max_age"))
    real = per.where((g.trunc(col("last_churn").cast("date")) == g.trunc(col("_last_snap").cast("date")))
                     & (col("first_churn") <= col("last_churn")))
    invol = col("_invol_churn").isNotNull() & (col("_invol_churn") <= col("last_churn"))
    return real.select("account", g.trunc(col("last_churn").cast("date")).alias("churn_month"),
                       F.when(invol, F.lit("Involuntary")).otherwise(F.lit("Voluntary")).alias("churn_type"),
                       F.when(col("_max_age") <= early_days, F.lit("Early Tenure"))
                        .when(col("_max_age").isNotNull(), F.lit("Long Tenure")).alias("tenure"))


def facts_from_summary(summary: DataFrame, key: str = KEY) -> DataFrame:
    """The involuntary-churn facts of ``period_facts`` read from the period
    summary (``snapshot.period_summary``)."""
    return summary.select(
        col(key), col("month"), col("any_below"),
        col("last.fix").alias("last_mora_fix"), col("last.raw").alias("last_overdue"),
        col("last.d").alias("last_record"), col("invol_rgu_churn"),
        F.datediff(col("last.d"), col("max_inst").cast("date")).alias("churn_tenure_days"))


def initial_rgus_from_summary(summary: DataFrame, key: str = KEY) -> DataFrame:
    """Products on the account's first record (D31) from the period summary:
    the first period's first-record products, one small aggregate."""
    f = F.min_by(col("first_products"), col("first_record"))
    return (summary.groupBy(key).agg(f.alias("_f"))
                   .select(col(key),
                           (col("_f.vo").isNotNull().cast("int") + col("_f.bb").isNotNull().cast("int")
                            + col("_f.tv").isNotNull().cast("int")).alias("max_rgus_count")))


def rejoiners_from_summary(table: DataFrame, summary: DataFrame, params: Params = Params(),
                           key: str = KEY) -> DataFrame:
    """``rejoiners`` with the active periods taken from the period summary."""
    active = summary.where(col("active") == 1).select(col(key).alias("exit_account"),
                                                        col("month").alias("rejoiner_month"))
    return _attach_rejoiners(table, active, params)


def _attach_rejoiners(table: DataFrame, active: DataFrame, params: Params) -> DataFrame:
    g = params.grain
    exits = (table.where(col("fixed_churner_type").isNotNull())
                  .select(col("fixed_account").alias("exit_account"),
                          g.shift(col("fixed_month"), 1).alias("rejoiner_month"),
                          col("fixed_churner_type").alias("_ctype")).distinct())
    rj = (exits.join(active, ["exit_account", "rejoiner_month"], "inner")
               .select("exit_account", "rejoiner_month",
                       case_when([(col("_ctype") == L.FIXED_VOL, L.FIXED_VOL_REJ),
                                  (col("_ctype") == L.FIXED_INVOL, L.FIXED_INVOL_REJ)]).alias("fixed_rejoiner_type")))
    rj = rj.groupBy("exit_account", "rejoiner_month").agg(F.max("fixed_rejoiner_type").alias("fixed_rejoiner_type"))
    j = table.join(rj, (col("fixed_month") == col("rejoiner_month")) & (col("fixed_account") == col("exit_account")),
                   "left")
    return j.withColumn("fixed_rejoiner", F.when(col("fixed_rejoiner_type").isNotNull(), col("fixed_account"))) \
            .drop("exit_account", "rejoiner_month")


def never_paid_by_churn(snap: DataFrame, churners: DataFrame, params: Params = Params(), days: int = 119,
                        key: str = KEY, churn_col: str = "cst_chrn_dt",
                        install_col: str = "act_acct_inst_dt") -> DataFrame:
    """Never-paid sales (D82): involuntary churners whose churn date is at
    most ``days`` days after their first installation, against all accounts
    installed in the same period. ``churners`` is ``churn_by_crm`` output;
    the snapshot is reduced to one row per account first."""
    g = params.grain
    per = snap.groupBy(col(key).alias("account")).agg(F.min(install_col).alias("_inst"),
                                                      F.max(churn_col).alias("_churn"))
    invol = churners.where(col("churn_type") == "Involuntary").select("account").withColumn("_inv", F.lit(1))
    j = per.join(invol, "account", "left")
    never = (col("_inv") == 1) & (F.datediff(col("_churn").cast("date"), col("_inst").cast("date")) <= days)
    out = j.groupBy(g.trunc(col("_inst").cast("date")).alias("install_month")).agg(
        F.count(F.lit(1)).alias("sales"), F.sum(never.cast("int")).cast("long").alias("never_paid"))
    return out.withColumn("never_paid_share",
                          F.round(F.try_divide(col("never_paid").cast("double"), col("sales").cast("double")), 3))
