"""Account snapshots and the opening/closing base.

The daily snapshot is read once and shuffled once, by account: every window
here is partitioned by the account (and sometimes the period, which the same
hash partitioning already satisfies), so the repair, the first/last values
and the period aggregates share one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.cache import col
from churnlens.functions.keys import days_between, present
from churnlens.functions.rules import bundle_name, bundle_size, case_when, technology_flag
from churnlens.params import Params

KEY = "act_acct_cd"
DAY = "dt"


def snapshot_features(df: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY) -> DataFrame:
    """Per account and day: period, product flags, bundle size (0P-3P),
    rounded charges, days since the oldest unpaid bill, first and last
    install, technology and the period's last overdue age (D10-D12)."""
    g = params.grain
    d = col(day).cast("date")
    w_acct = Window.partitionBy(key).orderBy(d)
    w_period = Window.partitionBy(key, "month").orderBy(d).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({
        "month": g.trunc(d),
        "rgu_vo": present("pd_vo_prod_nm").cast("int"),
        "rgu_tv": present("pd_tv_prod_nm").cast("int"),
        "rgu_bb": present("pd_bb_prod_nm").cast("int"),
        "mix": bundle_size("pd_vo_prod_nm", "pd_tv_prod_nm", "pd_bb_prod_nm"),
        "tech_flag": technology_flag("pd_bb_prod_nm", "pd_tv_prod_nm"),
        "mrc_vo": F.round("fi_vo_mrc_amt", 0),
        "mrc_bb": F.round("fi_bb_mrc_amt", 0),
        "mrc_tv": F.round("fi_tv_mrc_amt", 0),
        "avg_mrc": F.round(col("fi_vo_mrc_amt") + col("fi_bb_mrc_amt") + col("fi_tv_mrc_amt"), 0),
        "bill": F.round("fi_bill_amt_m0", 0),
        "mora": days_between("oldest_unpaid_bill_dt", d),
        "min_inst": F.first("act_acct_inst_dt").over(w_acct),
        "max_inst": F.max("act_acct_inst_dt").over(Window.partitionBy(key)),
    })
    out = out.withColumns({
        "num_rgus": col("rgu_vo") + col("rgu_tv") + col("rgu_bb"),
        "bundle_name": bundle_name("rgu_vo", "rgu_tv", "rgu_bb"),
        "last_overdue": F.last("fi_outst_age").over(w_period),
    })
    return out


def repair_overdue(df: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY,
                   age: str = "fi_outst_age", isolated_null: bool = True) -> DataFrame:
    """Repaired overdue age ``mora_fix``.

    A one-day spike (differs from both neighbours by more than ``spike_gap``
    in the same direction) becomes previous + 1; a one-day NULL between ``p``
    and ``p + 2`` becomes ``p + 1``; with ``isolated_null`` a record with no
    neighbour values gives NULL. Neighbours are the previous and next
    snapshot of the account (``lag``/``lead`` over one sorted partition).
    """
    w = Window.partitionBy(key).orderBy(col(day))
    a, gap = col(age), params.spike_gap
    out = df.withColumns({"prev_mora": F.lag(a).over(w), "next_mora": F.lead(a).over(w)})
    p, n = col("prev_mora"), col("next_mora")
    spike = ((a - p > gap) & (a - n > gap)) | ((a - p < -gap) & (a - n < -gap))
    rules = [(spike, p + 1), (a.isNull() & (n == p + 2), p + 1)]
    if isolated_null:
        rules.append((p.isNull() & n.isNull(), F.lit(None).cast("int")))
    return out.withColumn("mora_fix", case_when(rules, a).cast("int"))


_SIDE_COLS = [
    ("act_contact_phone_1", "phone"), ("pd_vo_prod_nm", "vo_nm"), ("pd_tv_prod_nm", "tv_nm"),
    ("pd_bb_prod_nm", "bb_nm"), ("rgu_vo", "rgu_vo"), ("rgu_tv", "rgu_tv"), ("rgu_bb", "rgu_bb"),
    ("fi_outst_age", "overdue"), ("c_cust_age", "tenure"), ("min_inst", "min_inst"),
    ("max_inst", "max_inst"), ("mix", "mix"), ("num_rgus", "num_rgus"), ("tech_flag", "tech_flag"),
    ("mora", "mora"), ("avg_mrc", "avg_mrc"), ("bill", "bill_amt"),
    ("act_cust_strt_dt", "act_cust_strt_dt"), ("bundle_name", "bundle_name"),
]


def snapshot_side(df: DataFrame, side: str, params: Params = Params(), key: str = KEY, day: str = DAY,
                  extra_days: tuple[str, ...] = (), use_repaired: bool = True) -> DataFrame:
    """Opening (``side='b'``) or closing (``side='e'``) snapshot.

    The opening of period ``p`` is the first-day snapshot of ``p``; the
    closing of ``p`` is the first-day snapshot of ``p + 1``. ``extra_days``
    adds listed snapshot days. Opening keeps overdue ``<= bom_max_overdue``,
    closing ``< eom_max_overdue`` (NULL passes; ``None`` disables).
    """
    g = params.grain
    d = col(day).cast("date")
    sel = d == g.trunc(d)
    for x in extra_days:
        sel = sel | (d == F.lit(x).cast("date"))
    age = col("mora_fix") if use_repaired else col("fi_outst_age")
    if side == "b":
        lim = params.bom_max_overdue
        keep = None if lim is None else (age <= lim) | age.isNull()
        month = g.trunc(d)
    else:
        lim = params.eom_max_overdue
        keep = None if lim is None else (age < lim) | age.isNull()
        month = g.shift(g.trunc(d), -1)
    if keep is not None:
        sel = sel & keep
    cols = [month.alias("month"), col(key).alias(f"account_{side}"), d.alias(f"{side}_date")]
    cols += [col(src).alias(f"{side}_{dst}") for src, dst in _SIDE_COLS]
    return df.where(sel).select(*cols)


def bom_eom_base(bom: DataFrame, eom: DataFrame) -> DataFrame:
    """Full outer join of opening and closing on (account, period) with
    ``active_bom`` / ``active_eom`` (D17)."""
    b = bom.withColumnRenamed("month", "_bm")
    e = eom.withColumnRenamed("month", "_em")
    j = b.join(e, (col("account_b") == col("account_e")) & (col("_bm") == col("_em")), "full")
    base = j.select(
        F.coalesce("_bm", "_em").alias("fixed_month"),
        F.coalesce("account_b", "account_e").alias("fixed_account"),
        F.when(col("account_b").isNotNull(), 1).otherwise(0).alias("active_bom"),
        F.when(col("account_e").isNotNull(), 1).otherwise(0).alias("active_eom"),
        *[c for c in bom.columns if c.startswith("b_")],
        *[c for c in eom.columns if c.startswith("e_")],
    )
    return base


def fixed_base(snap: DataFrame, params: Params = Params()) -> DataFrame:
    """Features -> repair -> opening/closing -> base, the first half of the
    fixed table."""
    f = snapshot_features(snap, params)
    r = repair_overdue(f, params)
    return bom_eom_base(snapshot_side(r, "b", params), snapshot_side(r, "e", params))


def active_by_mrc(df: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY,
                  mrc: str = "fi_bill_amt_m0", start: str = "act_cust_strt_dt") -> DataFrame:
    """Mean non-zero charge per account and period; keep rows of accounts
    with such a mean, or younger than ``young_account_days`` (D16)."""
    g = params.grain
    per = df.withColumn("month", g.trunc(col(day)))
    avg = (per.where(col(mrc) != 0).groupBy(key, "month").agg(F.avg(mrc).alias("avg_mrc")))
    j = per.join(avg, [key, "month"], "left")
    young = F.datediff(col(day).cast("date"), col(start).cast("date")) <= params.young_account_days
    return j.where(col("avg_mrc").isNotNull() | young)


def period_summary(rep: DataFrame, params: Params = Params(), key: str = KEY, day: str = DAY) -> DataFrame:
    """One row per (account, period) from the repaired daily rows: the
    distinct plan rows of the first day (``first_days``, structs of the
    opening/closing columns and the repaired age; ``first_day`` is one of
    them), whether some record is below the involuntary limit, the largest
    repaired and raw age on the last day, the products seen, the last
    install, the products on the first day and whether the account is
    active for a rejoin (overdue within the limit, or nothing overdue and a
    payment in the period).

    This is the only aggregate over the daily data. It runs on the hash
    partitioning by account that the repair window already produced (no
    further shuffle), and everything after it works at the period grain, so
    only this summary - not the daily stage - needs to be materialised."""
    g = params.grain
    d = col(day).cast("date")
    lim = params.invol_days
    first_day = F.struct(d.alias("date"), col("mora_fix").alias("mora_fix"),
                         *[col(src).alias(dst) for src, dst in _SIDE_COLS])
    on_first = F.when(d == g.trunc(d), first_day)
    # rows of one day tie: of the last day the largest ages count, of the first every product of some row
    at_last = lambda c: F.max(F.struct(d, col(c)))[c]
    at_first = lambda c: F.min(F.struct(d, col(c).isNull(), col(c)))[c]
    mf = col("mora_fix")
    active = (mf <= lim) | (mf.isNull() & (g.trunc(col("lst_pymt_dt").cast("date")) == col("month")))
    return rep.groupBy(key, "month").agg(
        F.max(on_first).alias("first_day"),
        F.collect_set(on_first).alias("first_days"),
        F.max((mf < lim).cast("int")).alias("any_below"),
        F.struct(at_last("mora_fix").alias("fix"), at_last("fi_outst_age").alias("raw"), F.max(d).alias("d")).alias("last"),
        (F.max(col("pd_vo_prod_nm").isNotNull().cast("int")) + F.max(col("pd_bb_prod_nm").isNotNull().cast("int"))
         + F.max(col("pd_tv_prod_nm").isNotNull().cast("int"))).alias("invol_rgu_churn"),
        F.max("max_inst").alias("max_inst"),
        F.struct(at_first("pd_vo_prod_nm").alias("vo"), at_first("pd_bb_prod_nm").alias("bb"),
                 at_first("pd_tv_prod_nm").alias("tv")).alias("first_products"),
        F.min(d).alias("first_record"),
        F.max(active.cast("int")).alias("active"),
    )


def summary_side(summary: DataFrame, side: str, params: Params = Params(), key: str = KEY) -> DataFrame:
    """Opening (``b``) or closing (``e``) snapshot from the period summary:
    the first-day rows of period p open p and close p - 1 (D14, D15), with
    the same overdue limits as ``snapshot_side``. An account with several
    distinct plan rows on that day has as many rows; the repaired age, which
    only the limits use, does not tell rows apart."""
    g = params.grain
    if side == "b":
        lim, month = params.bom_max_overdue, col("month")
        keep = lambda x: (x["mora_fix"] <= lim) | x["mora_fix"].isNull()
    else:
        lim, month = params.eom_max_overdue, g.shift(col("month"), -1)
        keep = lambda x: (x["mora_fix"] < lim) | x["mora_fix"].isNull()
    rows = col("first_days") if lim is None else F.filter("first_days", keep)
    rows = F.array_distinct(F.transform(rows, lambda x: x.dropFields("mora_fix")))
    fd = summary.select(col(key), month.alias("month"), F.explode(rows).alias("_fd"))
    cols = ["month", col(key).alias(f"account_{side}"), col("_fd.date").alias(f"{side}_date")]
    cols += [col(f"_fd.{dst}").alias(f"{side}_{dst}") for _, dst in _SIDE_COLS]
    return fd.select(*cols)
