"""Operational drivers of new and existing customers.

Each driver is a set of (account, period) keys. Instead of ten chained left
joins to the master table, the sets are unioned into one narrow frame,
reduced to one row per (account, period) with a 0/1 column per driver, and
joined to the master table once (one shuffle of the master, not ten).

Distinct-account counts of many flags are computed as one row per
(period, account) with ``max`` per flag, then plain sums: no ``Expand``
for eleven ``count(distinct)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.cache import col
from churnlens import labels as L
from churnlens.functions.keys import days_between
from churnlens.params import Params
from churnlens.sources.io import dedupe_latest

# ---------------------------------------------------------------- events ----


def dedupe_interactions(inter: DataFrame, types=L.RESIDENTIAL_TYPES, void=()) -> DataFrame:
    """Residential interactions, latest per account, day and purpose.

    Interactions of a ``void`` status go before the latest is taken (the
    driver table: a valid call stays when a void one follows it); with none,
    the latest is taken whatever its status (the contact windows)."""
    i = inter.where(col("account_type").isin(list(types)))
    if void:
        i = i.where(~col("interaction_status").isin(list(void)))
    return dedupe_latest(i, ["account_id", F.to_date("interaction_start_time"), "interaction_purpose_descrip"],
                         col("interaction_start_time"), tie_break=["interaction_id"])


def calls(dedup: DataFrame, void=("ANULADA",)) -> DataFrame:
    """Customer calls: not voided, not a counter/sales purpose."""
    return dedup.where(~col("interaction_status").isin(list(void))
                       & ~col("interaction_purpose_descrip").isin(list(L.NON_CALL_PURPOSES)))


def tech_tickets(dedup: DataFrame) -> DataFrame:
    return dedup.where((col("interaction_status") != "ANULADA")
                       & col("interaction_purpose_descrip").isin(list(L.TECH_TICKET_PURPOSES)))


def billing_calls(dedup: DataFrame) -> DataFrame:
    return dedup.where(col("account_id").isNotNull() & (col("interaction_status") != "ANULADA")
                       & col("interaction_purpose_descrip").isin(list(L.BILLING_PURPOSES)))


# ------------------------------------------------------------ new customers --


def account_starts(snap: DataFrame, key: str = "act_acct_cd", day: str = "dt") -> DataFrame:
    """Per account: first snapshot day and the latest start date seen.
    (``snapshot_driver_sets`` computes this with the other snapshot-based
    sets in one pass; the single-set functions are kept for separate use.)"""
    return snap.groupBy(col(key).alias("account")).agg(
        F.min(day).alias("first_dna_date"), F.max("act_cust_strt_dt").alias("last_start"))


def early_contact(events: DataFrame, starts: DataFrame, days: int, params: Params = Params(),
                  unit: str = "day") -> DataFrame:
    """Accounts with a contact at most ``days`` after a start, flagged in the
    period of their first snapshot (D83, D84).

    There is no lower bound (a contact before the start counts, as in the
    final scripts), so "some start s with t <= s + days" is "t <= latest
    start + days": one row per account on the start side, and the contact
    side joins it one-to-one. ``unit='week'`` counts whole weeks (``days``
    is then a number of weeks)."""
    g = params.grain
    t = F.to_date("interaction_start_time")
    j = events.select(col("account_id").alias("account"), t.alias("_t")).join(starts, "account", "inner")
    d = days_between("last_start", "_t")
    ok = (F.floor(d / 7) <= days) | (d < 0) if unit == "week" else (d <= days)
    return j.where(ok).select("account", g.trunc(col("first_dna_date")).alias("month")).distinct()


def contacts_after_start(events: DataFrame, starts: DataFrame, bands, params: Params = Params(), anchor: str = "start") -> DataFrame:
    """Contacts of an account by their distance from the last start at or
    before them (D83, D84 with the lower bound of the older scripts).

    ``bands`` are (name, unit, least, most) with unit 'day' or 'period' (period
    borders crossed). ``anchor`` 'start' gives a row per (account, start), with
    zeros where no contact followed, in the period of the start; 'event' gives
    a row per (account, start, period of the contacts). Contacts before any
    start are left out.

    Contacts are counted per (account, day) first; starts and days then stand
    in one sequence per account and the last start is carried forward, so an
    account costs its days, not starts times contacts."""
    if anchor not in ("start", "event"):
        raise ValueError(anchor)
    g = params.grain
    n = events.where(col("account_id").isNotNull()).groupBy(
        col("account_id").alias("account"), F.to_date("interaction_start_time").alias("_day")).agg(
        F.count_distinct("interaction_id").alias("_n"))
    s = starts.select("account", col("start").cast("date").alias("_day")).where(col("account").isNotNull() & col("_day").isNotNull()).distinct()
    both = n.withColumn("_kind", F.lit(1)).unionByName(s.withColumns({"_kind": F.lit(0), "_start": col("_day")}), allowMissingColumns=True)
    upto = Window.partitionBy("account").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = both.withColumn("start", F.last("_start", ignorenulls=True).over(upto)).where(col("start").isNotNull())
    if anchor == "event":
        j = j.where(col("_kind") == 1)
    away = {"day": F.datediff(col("_day"), col("start")), "period": g.periods_between(col("start"), col("_day"))}
    month = g.trunc(col("start") if anchor == "start" else col("_day")).alias("month")
    return j.groupBy("account", "start", month).agg(*[
        F.coalesce(F.sum(F.when(away[unit].between(least, most), col("_n"))), F.lit(0)).cast("long").alias(name)
        for name, unit, least, most in bands])


def first_bill_risk(repaired: DataFrame, params: Params = Params(), key: str = "act_acct_cd") -> DataFrame:
    """Soft disconnection and never-paid flags (D81): the highest repaired
    age while the oldest unpaid bill is the account's first bill, keyed by
    the sales period."""
    g = params.grain
    # the account's first bill as a window on the repair window's partitioning
    # (no aggregate-and-join-back of the daily rows)
    first_bill = F.min("bill_dt_m0").over(Window.partitionBy(key))
    j = repaired.withColumn("_fb", first_bill).where(
        g.trunc(col("oldest_unpaid_bill_dt")) == g.trunc(col("_fb")))
    m = j.groupBy(col(key).alias("account"), g.trunc(col("act_cust_strt_dt")).alias("month")) \
         .agg(F.max("mora_fix").alias("outstanding_days"))
    return m.select("account", "month",
                    (col("outstanding_days") >= params.soft_dx_days).cast("int").alias("soft_dx"),
                    (col("outstanding_days") >= params.never_paid_days).cast("int").alias("never_paid"))


def sales(snap: DataFrame, params: Params = Params(), key: str = "act_acct_cd", day: str = "dt") -> DataFrame:
    """Sale period per account (D80): the install period, or the period of
    the first active snapshot when the install is earlier."""
    g = params.grain
    act = snap.where(col("act_cust_typ").isin(list(L.RESIDENTIAL_TYPES)) & (col("act_acct_stat") == "ACTIVO"))
    first = act.groupBy(key).agg(F.min(day).alias("_first"))
    inst = act.select(key, g.trunc(col("act_acct_inst_dt")).alias("_inst")).distinct()
    j = inst.join(first, key, "inner")
    fm = g.trunc(col("_first"))
    return j.select(col(key).alias("account"),
                    F.when(col("_inst") >= fm, col("_inst")).otherwise(fm).alias("month")).distinct()


def long_installs(orders: DataFrame, params: Params = Params()) -> DataFrame:
    """Finished installations that took ``outlier_install_days`` or more
    days, keyed by the completion period (D87)."""
    g = params.grain
    o = orders.where((col("order_type") == L.ORDER_INSTALL) & (col("order_status") == L.ORDER_DONE)
                     & (days_between("order_start_date", "completed_date") >= params.outlier_install_days))
    return o.select(col("account_name").alias("account"), g.trunc(col("completed_date")).alias("month")).distinct()


def first_day_bills(snap: DataFrame, params: Params = Params(), key: str = "act_acct_cd", day: str = "dt") -> DataFrame:
    """(account, month, o, b): oldest unpaid bill and current bill on a period's first snapshot day."""
    g = params.grain
    d = col(day).cast("date")
    return snap.where(d == g.trunc(d)).select(col(key).alias("account"), g.trunc(d).alias("month"),
                                             col("oldest_unpaid_bill_dt").alias("o"), col("bill_dt_m0").alias("b")).distinct()


def mounting_bills(first_days: DataFrame, params: Params = Params(), periods: int = 1) -> DataFrame:
    """The same oldest unpaid bill on the first days of two periods that lie
    ``periods`` apart, with a current bill in the later one (D88). Two gives
    the form over three snapshots, which compares the first with the third."""
    g = params.grain
    a = first_days.select(col("account").alias("_a"), g.shift(col("month"), periods).alias("_m"), col("o").alias("_o"))
    j = first_days.where(col("b").isNotNull()).join(
        a, (col("account") == col("_a")) & (col("month") == col("_m")) & (col("o") == col("_o")), "inner")
    return j.select("account", "month").distinct()


def sales_channel(orders: DataFrame, params: Params = Params(), mapping: DataFrame | None = None) -> DataFrame:
    """Channel of the account's first finished installation, attached to
    every installation period of the account (D89); ``mapping`` (channel ->
    group) is a small catalogue joined by broadcast."""
    g = params.grain
    o = orders.where((col("order_type") == L.ORDER_INSTALL) & (col("order_status") == L.ORDER_DONE))
    first = o.groupBy(col("account_name").alias("account")).agg(
        F.min_by("channel_desc", F.struct("order_start_date", "order_id")).alias("sales_channel"))
    per = o.select(col("account_name").alias("account"), g.trunc(col("order_start_date")).alias("month")).distinct()
    out = per.join(first, "account", "inner")
    if mapping is not None:
        from churnlens.plans.sizing import broadcast_if_small
        groups = broadcast_if_small(mapping.withColumnRenamed(mapping.columns[0], "_channel"))
        out = out.join(groups, col("sales_channel") == col("_channel"), "left").drop("_channel")
    return out


def billing_claims(dedup: DataFrame, params: Params = Params()) -> DataFrame:
    """Accounts with billing calls per period and their number."""
    g = params.grain
    c = billing_calls(dedup)
    return (c.groupBy(col("account_id").alias("account"), g.trunc(F.to_date("interaction_start_time")).alias("month"))
             .agg(F.count_distinct("interaction_id").alias("num_calls")))


def failed_visits(dedup: DataFrame, params: Params = Params()) -> DataFrame:
    """Cancelled or annulled visits by period."""
    g = params.grain
    return (dedup.where(col("interaction_status").isin(list(L.VOID_STATUSES)))
                 .select(col("account_id").alias("account"),
                         g.trunc(F.to_date("interaction_start_time")).alias("month")).distinct())


def ticket_density(dedup: DataFrame, params: Params = Params()) -> DataFrame:
    """Technical tickets per account and period."""
    g = params.grain
    t = dedup.where(col("interaction_purpose_descrip").isin(list(L.TECH_TICKET_PURPOSES)))
    return (t.groupBy(col("account_id").alias("account"), g.trunc(F.to_date("interaction_start_time")).alias("month"))
             .agg(F.count_distinct("interaction_id").alias("num_tech_tickets")))


# ---------------------------------------------------------- contact windows --


def contacts_in_window(all_events: DataFrame, anchor_events: DataFrame, params: Params = Params(),
                       days: int | None = None) -> DataFrame:
    """Number of distinct contacts in the ``days`` days up to the last anchor
    contact of each (account, period) (D92, D94).

    Each contact is copied into the few periods whose windows can reach it
    (its own period up to the period of day + ``days``) and joined to the one
    anchor day of that (account, period); the distinct ids in range are
    counted by two-level aggregation, so an id on two days counts once and a
    hot account is split by period and by id. Linear in contacts.
    """
    g = params.grain
    n = params.contact_window_days if days is None else days
    day = F.to_date("interaction_start_time")
    contacts = all_events.select(col("account_id").alias("account"), "interaction_id", day.alias("_day")).withColumn(
        "month", F.explode(g.periods_covering(col("_day"), F.date_add("_day", n))))
    last = anchor_events.groupBy(col("account_id").alias("account"), g.trunc(day).alias("month")).agg(
        F.max(day).alias("_last"))
    near = contacts.join(last, ["account", "month"]).where(col("_day").between(F.date_sub("_last", n), col("_last")))
    return (near.select("account", "month", "interaction_id").distinct()
                .groupBy("account", "month").agg(F.count("interaction_id").alias("contacts")))


def contacts_in_month(events: DataFrame, params: Params = Params()) -> DataFrame:
    """Distinct contacts per account and calendar period."""
    g = params.grain
    return (events.groupBy(col("account_id").alias("account"),
                           g.trunc(F.to_date("interaction_start_time")).alias("month"))
                  .agg(F.count_distinct("interaction_id").cast("long").alias("contacts")))


def tiers(counts: DataFrame, prefix: str) -> DataFrame:
    """1, 2, 3+ tiers as 0/1 columns."""
    c = col("contacts")
    return counts.select("account", "month", (c == 1).cast("int").alias(f"one_{prefix}"),
                         (c == 2).cast("int").alias(f"two_{prefix}"), (c >= 3).cast("int").alias(f"multiple_{prefix}"))


# ---------------------------------------------------------------- enrich ----


def keyed_flags(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Union of (account, month) key sets into one row per key with a 0/1
    column per set."""
    u = None
    for name, df in sets.items():
        d = df.select(col("account").cast("string").alias("account"), col("month").cast("date").alias("month"),
                      F.lit(name).alias("_flag"))
        u = d if u is None else u.unionByName(d)
    return u.groupBy("account", "month").agg(
        *[F.max((col("_flag") == n).cast("int")).alias(n) for n in sets])


def keyed_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of (account, month, 0/1 columns) as one row per key with every
    column: a frame that holds several flags is planned once."""
    u = None
    for df in frames:
        names = [c for c in df.columns if c not in ("account", "month")]
        d = df.select(col("account").cast("string").alias("account"), col("month").cast("date").alias("month"), *names)
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    flags = [c for c in u.columns if c not in ("account", "month")]
    return u.groupBy("account", "month").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in flags])


def enrich(master: DataFrame, flags: DataFrame, account: str = "fixed_account", month: str = "month") -> DataFrame:
    """One left join of all flags; each flag holds the account key or NULL."""
    names = [c for c in flags.columns if c not in ("account", "month")]
    f = flags.withColumnRenamed("account", "_fa").withColumnRenamed("month", "_fm")
    j = master.join(f, (col(account) == col("_fa")) & (col(month) == col("_fm")), "left")
    return j.withColumns({f"{n}_flag": F.when(col(n) == 1, col(account)) for n in names}).drop("_fa", "_fm", *names)


def bill_shock_flags(master: DataFrame, params: Params = Params(), account: str = "fixed_account") -> DataFrame:
    """Plan unchanged and an MRC change above ``bill_shock_pct``."""
    no_change = col("b_plan_full") == col("e_plan_full")
    shock = (F.abs(col("mrc_change")) > col("b_total_mrc") * params.bill_shock_pct) \
        & (col("b_plan") == col("e_plan")) & no_change
    return master.withColumns({"no_plan_change_flag": F.when(no_change, col(account)),
                               "increase_flag": F.when(shock, col(account))})


EXCLUDED_CHURN = ("Fixed Churner", "Customer Gap", "Full Churner", "Churn Exception")


def driver_summary(master: DataFrame, flag_cols, account: str = "fixed_account", month: str = "month", by=()) -> DataFrame:
    """Distinct accounts per flag and period, churners excluded (D90, D97):
    one row per (period, segment, account) first, then sums, so no distinct
    count per flag. ``by`` names segment columns; an account counts once in
    each segment it has rows in."""
    by = list(by)
    m = master.where(~col("final_churn_flag").isin(list(EXCLUDED_CHURN)) & col(account).isNotNull())
    per = m.groupBy(month, *by, account).agg(*[F.max(col(c).isNotNull().cast("int")).alias(c) for c in flag_cols])
    return per.groupBy(month, *by).agg(F.count(F.lit(1)).alias("activebase"),
                                       *[F.sum(c).cast("long").alias(c) for c in flag_cols])


def flag_rate(summary: DataFrame, flags, base: str, digits: int = 4) -> DataFrame:
    """Flagged accounts over the base (new installations) per period."""
    flags = [flags] if isinstance(flags, str) else list(flags)
    return summary.select("month", *[
        F.round(F.try_divide(col(f).cast("double"), col(base).cast("double")), digits).alias(f"{f}_rate")
        for f in flags])


def caller_tiers_by_month(events: DataFrame, params: Params = Params()) -> DataFrame:
    """Accounts with 1, 2 and 3+ contacts in each calendar period."""
    t = tiers(contacts_in_month(events, params), "call")
    return t.groupBy("month").agg(F.sum("one_call").cast("long").alias("one_call"),
                                  F.sum("two_call").cast("long").alias("two_calls"),
                                  F.sum("multiple_call").cast("long").alias("multiple_calls"))


def snapshot_driver_sets(snap: DataFrame, params: Params = Params(), key: str = "act_acct_cd",
                         day: str = "dt", stage: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The four snapshot-based driver sets (D80, D81, D83/D84 starts, D88)
    from one pass over the daily data: one hash partitioning by account
    carries the repair window and the account's first bill, then a single
    aggregate per (account, period, start period, install period) keeps
    what each set needs. The sets are small aggregates of that summary, which
    ``stage`` writes once, so the daily data is read and shuffled once instead
    of once per set."""
    from churnlens.operators.snapshot import repair_overdue
    g = params.grain
    d = col(day).cast("date")
    rep = repair_overdue(snap, params, isolated_null=False, key=key, day=day)
    rep = rep.withColumn("_fb", F.min("bill_dt_m0").over(Window.partitionBy(key)))
    active = col("act_cust_typ").isin(list(L.RESIDENTIAL_TYPES)) & (col("act_acct_stat") == "ACTIVO")
    risk_row = g.trunc(col("oldest_unpaid_bill_dt")) == g.trunc(col("_fb"))
    fd = F.struct(col("oldest_unpaid_bill_dt").alias("o"), col("bill_dt_m0").alias("b"))
    summ = rep.groupBy(col(key).alias("account"), g.trunc(d).alias("month"),
                       g.trunc(col("act_cust_strt_dt")).alias("start_month"),
                       g.trunc(col("act_acct_inst_dt")).alias("inst_month")).agg(
        F.min(d).alias("min_dt"), F.max("act_cust_strt_dt").alias("max_start"),
        F.min(F.when(active, d)).alias("min_active_dt"), F.max(active.cast("int")).alias("any_active"),
        F.collect_set(F.when(d == g.trunc(d), fd)).alias("first_day"),  # rows of one account on one day
        F.max(F.when(risk_row, col("mora_fix"))).alias("risk_age"),
        F.max(risk_row.cast("int")).alias("any_risk"))
    summ = summ if stage is None else stage(summ, "driver-sets")
    starts = summ.groupBy("account").agg(F.min("min_dt").alias("first_dna_date"), F.max("max_start").alias("last_start"))
    first_active = summ.groupBy("account").agg(F.min("min_active_dt").alias("_first"))
    inst = summ.where(col("any_active") == 1).select("account", col("inst_month").alias("_inst")).distinct()
    fm = g.trunc(col("_first"))
    sales_set = (inst.join(first_active.where(col("_first").isNotNull()), "account", "inner")
                     .select("account", F.when(col("_inst") >= fm, col("_inst")).otherwise(fm).alias("month")).distinct())
    risk = (summ.where(col("any_risk") == 1).groupBy("account", col("start_month").alias("month"))
                .agg(F.max("risk_age").alias("outstanding_days"))
                .select("account", "month",
                        (col("outstanding_days") >= params.soft_dx_days).cast("int").alias("soft_dx"),
                        (col("outstanding_days") >= params.never_paid_days).cast("int").alias("never_paid")))
    fdays = (summ.select("account", "month", F.explode("first_day").alias("fd"))
                 .select("account", "month", col("fd.o").alias("o"), col("fd.b").alias("b")).distinct())
    mounting = mounting_bills(fdays, params)
    return {"starts": starts, "sales": sales_set, "risk": risk, "mounting": mounting}
