"""Data-quality reports (D120-D123)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.cache import col
from churnlens.functions.keys import present
from churnlens.params import Params


def all_null_accounts(snap: DataFrame, params: Params = Params(), key: str = "act_acct_cd", day: str = "dt",
                      mrc_cols=("fi_vo_mrc_amt", "fi_tv_mrc_amt", "fi_bb_mrc_amt")) -> DataFrame:
    """Accounts whose charge is NULL or 0 on every day of the period (D120):
    an account with a day without a snapshot is not one."""
    g = params.grain
    mrc = sum((F.coalesce(col(c), F.lit(0.0)) for c in mrc_cols), F.lit(0.0))
    per = snap.groupBy(col(key).alias("account"), g.trunc(col(day)).alias("month")).agg(
        F.sum((mrc == 0).cast("int")).cast("long").alias("days"))
    return per.where(col("days") == F.datediff(g.shift(col("month"), 1), col("month"))).select("month", "account", "days")


def intermittent(snap: DataFrame, params: Params = Params(), key: str = "act_acct_cd", day: str = "dt") -> DataFrame:
    """Accounts without products on the period's first day and with products
    on another snapshot of it, counted per period (D121)."""
    g = params.grain
    has = (present("pd_vo_prod_nm") | present("pd_tv_prod_nm") | present("pd_bb_prod_nm")).cast("int")
    per = snap.groupBy(col(key).alias("account"), g.trunc(col(day)).alias("month")).agg(
        F.max(has).alias("_with"), F.max(F.when(col(day).cast("date") == g.trunc(col(day)), has)).alias("_opening"))
    return (per.where((col("_with") == 1) & (col("_opening") == 0)).groupBy("month")
               .agg(F.count(F.lit(1)).alias("intermittent_accounts")))


def overdue_histogram(repaired: DataFrame, params: Params = Params(), key: str = "act_acct_cd",
                      day: str = "dt") -> DataFrame:
    """Accounts by period and repaired overdue age (D122)."""
    g = params.grain
    return (repaired.groupBy(g.trunc(col(day)).alias("month"), col("mora_fix"))
                    .agg(F.count_distinct(key).alias("accounts")))


def account_history(snap: DataFrame, account: str, key: str = "act_acct_cd", day: str = "dt") -> DataFrame:
    """All snapshots of one account in day order (D123)."""
    return snap.where(col(key) == account).orderBy(day)
