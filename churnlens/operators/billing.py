"""Billing: overdue age from payments, debt and retention funnels, first
bill and payment, oldest unpaid bill, payment reconciliation (D100-D106)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens import labels as L
from churnlens.functions.cache import col
from churnlens.functions.keys import pad_key
from churnlens.functions.rules import case_when
from churnlens.params import Params


def overdue_from_payment(snap: DataFrame, params: Params = Params(), key: str = "act_acct_cd",
                         day: str = "dt", paid: str = "lst_pymt_dt") -> DataFrame:
    """Oldest unpaid bill = the period after the last payment, NULL when the
    last payment is in the current period; age in days (D100)."""
    g = params.grain
    d = col(day).cast("date")
    adj = g.trunc(g.shift(col(paid).cast("date"), 1))
    oldest = F.when(g.trunc(col(paid).cast("date")) == g.trunc(d), F.lit(None).cast("date")).otherwise(adj)
    return snap.withColumn("oldest_unpaid_bill_final", oldest) \
               .withColumn("fi_outst_age_final", F.datediff(d, col("oldest_unpaid_bill_final")))


def debt_funnel(snap: DataFrame, params: Params = Params(),
                stages: Sequence[tuple[str, int, int | None, str, int]] = (
                    ("overdue", 21, None, "fi_outst_age_final", 0), ("soft_dx", 27, None, "fi_outst_age_final", 0),
                    ("hard_dx", 90, None, "fi_outst_age_final", 3)),
                key: str = "act_acct_cd", day: str = "dt") -> DataFrame:
    """Involuntary funnel (D101).

    The cohort of a period is the accounts billed in it and not yet overdue;
    each stage ``(name, lo, hi, age column, periods back)`` keeps the
    accounts whose age falls in [lo, hi] in the period ``periods back`` after
    the cohort. All sets are (account, period) keys joined one-to-one."""
    g = params.grain
    d = col(day).cast("date")
    p = g.trunc(d)
    age = col("fi_outst_age_final")
    cohort = (snap.where((g.trunc(col("bill_dt_m0").cast("date")) == p) & ((age == 0) | age.isNull()))
                  .select(col(key).alias("account"), p.alias("month")).distinct())
    out = cohort
    for name, lo, hi, age_col, back in stages:
        a = col(age_col)
        cond = (a >= lo) if hi is None else a.between(lo, hi)
        s = (snap.where(cond).select(col(key).alias("account"), g.shift(p, -back).alias("month")).distinct()
                 .withColumn(name, F.lit(1)))
        out = out.join(s, ["account", "month"], "left")
    return out.groupBy("month").agg(F.count(F.lit(1)).alias("billed"),
                                    *[F.count(col(s[0])).alias(s[0]) for s in stages])


# Bands of the backlog funnel in days: (stage, ((age column, least, most), ...)); all predicates of a stage hold together.
DEBT_BANDS = (
    ("day_one", (("fi_outst_age_final", 21, 25),)), ("soft_dx", (("fi_outst_age_final", 27, 32),)),
    ("backlog", (("fi_outst_age_final", 63, None), ("fi_outst_age", None, 89))), ("hard_dx", (("fi_outst_age", 90, 95),)),
)


def debt_bands(snap: DataFrame, params: Params = Params(), bands=DEBT_BANDS, cohort_max: int = 90,
               cohort_age: str = "fi_outst_age_final", key: str = "act_acct_cd", day: str = "dt",
               bill: str = "bill_dt_m0") -> DataFrame:
    """Involuntary funnel by bands over two age columns (D102): accounts and
    billed accounts per period and combination of stages.

    An account is billed in the period of its bill date when its age is at
    most ``cohort_max`` or unknown; it is in a stage of a period when one of
    its days there meets the stage's predicates. One scan gives each day's
    marks for its own period and, where the bill lies in another, that one's;
    one aggregate per (account, period) takes their maximum - no joins."""
    g = params.grain
    own, billed_in = g.trunc(col(day).cast("date")), g.trunc(col(bill).cast("date"))
    cohort = col(bill).isNotNull() & ((col(cohort_age) <= cohort_max) | col(cohort_age).isNull())

    def within(column, least, most):
        tests = [col(column) >= least] * (least is not None) + [col(column) <= most] * (most is not None)
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]

    stages = {}
    for name, predicates in bands:
        meets = F.lit(True)
        for p in predicates:
            meets = meets & within(*p)
        stages[name] = F.coalesce(meets, F.lit(False)).cast("int")

    def marks(month, seen, billed, flags):
        return F.struct(month.alias("month"), F.lit(seen).alias("_seen"), billed.alias("_billed"),
                        *[flags(n).alias(n) for n in stages])

    here = marks(own, 1, (cohort & (billed_in == own)).cast("int"), lambda n: stages[n])
    there = marks(billed_in, 0, F.lit(1), lambda n: F.lit(0))
    away = cohort & (billed_in != own)
    each = snap.where(col(key).isNotNull()).select(col(key).alias("account"), F.inline(F.when(away, F.array(here, there)).otherwise(F.array(here))))
    per = each.groupBy("account", "month").agg(F.max("_seen").alias("_seen"), F.max(F.coalesce("_billed", F.lit(0))).alias("_billed"),
                                               *[F.max(n).alias(n) for n in stages])
    return per.where("_seen = 1").groupBy("month", *stages).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("_billed").cast("long").alias("billed"))


def retention_funnel(requests: DataFrame, master: DataFrame, params: Params = Params(), rgus: str = "b_total_rgus") -> DataFrame:
    """Disconnection requests -> located -> retained, in accounts of the
    master table and their opening products (D103); keys are padded."""
    g = params.grain
    r = requests.select(pad_key(col("contrato")).alias("_ra"), g.trunc(col("request_date").cast("date")).alias("_rm"),
                        F.coalesce(col("contactabilidad") == L.LOCATED, F.lit(False)).cast("int").alias("_loc"),
                        F.coalesce(col("solucion") == L.RETAINED, F.lit(False)).cast("int").alias("_ret"))
    per = r.groupBy("_ra", "_rm").agg(F.max("_loc").alias("_loc"), F.max("_ret").alias("_ret"))
    m = master.where(col("fixed_account").isNotNull()).groupBy("month", pad_key(col("fixed_account")).alias("_ra")).agg(
        F.sum(F.coalesce(col(rgus), F.lit(0.0))).alias("_rgus"))
    j = m.join(per.withColumnRenamed("_rm", "month"), ["_ra", "month"])
    total = lambda c: F.round(F.sum(c), 4)
    return j.groupBy("month").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("_loc").cast("long").alias("located"),
        F.sum("_ret").cast("long").alias("retained"), total(col("_rgus")).alias("request_rgus"),
        total(col("_rgus") * col("_loc")).alias("located_rgus"), total(col("_rgus") * col("_ret")).alias("retained_rgus"))


def bill_payments(bills: DataFrame, moves: DataFrame, params: Params = Params()) -> DataFrame:
    """First bill per account and period with its first payment (D104).
    Payments are reduced per bill first (partial aggregation), then joined
    one-to-one to the bills by their ids padded to ten digits."""
    g = params.grain
    pay = moves.groupBy(pad_key("fact_aplica", 10).alias("_paid")).agg(F.min("fecha_mov").alias("first_payment"))
    b = bills.join(pay, pad_key("factura", 10) == col("_paid"), "left").withColumn("month", g.trunc(col("fecha_fact")))
    first = F.min_by(F.struct("fecha_fact", "factura", "first_payment"), F.struct(col("fecha_fact"), pad_key("factura", 10)))
    return (b.groupBy("contrato", "month").agg(first.alias("_f"))
             .select("contrato", "month", col("_f.factura").alias("first_bill"),
                     col("_f.fecha_fact").alias("bill_date"), col("_f.first_payment").alias("first_payment")))


def bill_standing(first_bills: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """What the unpaid-bill rules need of an account's first bills (D105):
    per (account, period) the bill and, where it was dated exactly one period
    before, the previous one, each with its payment; and per account its oldest
    unpaid bill and the first and the last bill that was paid.

    An account has one first bill per period, so the window and the aggregate
    hold no more rows per account than there are periods."""
    g = params.grain
    before = Window.partitionBy("contrato").orderBy("month")
    prev = F.lag(F.struct("bill_date", "first_payment")).over(before)
    follows = g.shift(col("_prev.bill_date"), 1) == col("bill_date")
    bills = first_bills.withColumn("_prev", prev).select(
        col("contrato").alias("_bc"), col("month").alias("_bm"), "bill_date", "first_payment",
        F.when(follows, col("_prev.bill_date")).alias("prev_bill"), F.when(follows, col("_prev.first_payment")).alias("prev_payment"))
    paid = col("first_payment").isNotNull()
    order = F.when(paid, F.struct("first_payment", "month"))
    accounts = first_bills.groupBy(col("contrato").alias("_ac")).agg(
        F.min(F.when(~paid, col("bill_date"))).alias("unpaid_bill"), F.min(order).alias("_first"), F.max(order).alias("_last"))
    return bills, accounts


def oldest_unpaid(days: DataFrame, first_bills: DataFrame, params: Params = Params(), account: str = "act_acct_cd",
                  day: str = "dt") -> DataFrame:
    """Oldest unpaid bill on every snapshot day of an account and its age in
    days (D105). Eight rules in order: the account's first paid bill while it
    was open; nothing once the period's bill is paid; the period's bill or the
    previous one while open, by which of them was paid when; the oldest bill
    never paid, when the period has a bill; the last paid bill while it was
    open. Bills paid the same day count in order of their period.

    Days meet the standing of their account by two joins on the account (the
    second also on the period); a hot account's days can be split, the other
    side has a row per account and period."""
    bills, accounts = bill_standing(first_bills, params)
    d = days.select(col(account).alias("contrato"), col(day).cast("date").alias("day")).distinct()
    d = d.join(accounts, col("contrato") == col("_ac"), "left")
    d = d.join(bills, (col("contrato") == col("_bc")) & (params.grain.trunc(col("day")) == col("_bm")), "left")
    t, bill, paid = col("day"), col("bill_date"), col("first_payment")
    prev, prev_paid, never = col("prev_bill"), col("prev_payment"), col("unpaid_bill")
    first, last = col("_first.month"), col("_last.month")
    oldest = case_when([
        ((t < col("_first.first_payment")) & (t >= first), first),
        (t >= paid, F.lit(None).cast("date")),
        ((paid > t) & prev_paid.isNull() & prev.isNull() & (t >= bill), bill),
        ((t < paid) & (t < prev_paid) & (t >= prev), prev),
        ((t >= prev_paid) & (t <= paid) & (t >= bill), bill),
        (paid.isNull() & prev_paid.isNotNull() & (t < prev_paid) & (t >= prev), prev),
        (bill.isNotNull() & (t >= never), never),
        ((t < col("_last.first_payment")) & (t >= last), last),
    ])
    return d.select("contrato", "day", bill.alias("current_bill"), oldest.alias("oldest_unpaid_bill"),
                    F.datediff(t, oldest).alias("overdue_days"))


def reconcile_payments(payments: DataFrame, first_bills: DataFrame, moves: DataFrame) -> DataFrame:
    """Two sources of the same payments (D106): the payment table's total per
    invoice against the bill movements' total, for first bills of a period
    that both know. Repeated payment rows are one, invoice ``-1`` is none;
    totals are reduced per invoice first, then joined one-to-one on ids padded
    to ten digits."""
    paid = payments.where(col("invoice_id") != "-1").distinct().groupBy(pad_key("invoice_id", 10).alias("invoice")).agg(
        F.round(F.sum("payment_amt_local"), 2).alias("payment_total"))
    moved = moves.groupBy(pad_key("fact_aplica", 10).alias("invoice")).agg(
        F.min("fecha_mov").alias("first_movement"), F.round(F.sum("monto_fact"), 0).alias("movement_total"))
    bills = first_bills.select(pad_key("first_bill", 10).alias("invoice"), "contrato", "month", "bill_date")
    j = paid.join(bills, "invoice").join(moved, "invoice")
    return j.withColumn("difference", F.round(col("payment_total") - col("movement_total"), 2))


def reconcile(bills: DataFrame, moves: DataFrame) -> DataFrame:
    """Billed amount against the sum of payment movements per invoice (D106)."""
    pay = moves.groupBy(col("fact_aplica").alias("factura")).agg(F.round(F.sum("monto_mov"), 2).alias("paid"))
    j = bills.select("factura", col("monto_fact").alias("billed")).join(pay, "factura", "inner")
    return j.withColumn("difference", F.round(col("billed") - col("paid"), 2))
