"""Second forms of the churn rules: end records, deinstallations, padded keys."""
import datetime as dt

from churnlens import labels as L
from churnlens.operators import churn as C
from churnlens.params import Params

P = Params(invol_days=90)
JAN, FEB, MAR = (dt.date(2022, m, 1) for m in (1, 2, 3))


def d(text):
    return dt.date.fromisoformat(text)


def test_end_records(spark):
    rows = [("a", "2022-01-02", 90), ("a", "2022-01-10", 95), ("a", "2022-01-31", 90),  # both limits included
            ("b", "2022-01-02", 91), ("b", "2022-01-10", 5), ("b", "2022-01-31", 120),  # below the limit only between the ends
            ("c", "2022-01-02", None), ("c", "2022-01-31", 95), ("d", "2022-01-02", 5), ("d", "2022-01-31", None),
            ("e", "2022-01-02", None), ("e", "2022-01-02", 7), ("e", "2022-01-31", 95), ("e", "2022-01-31", 3),  # any row of the day
            (None, "2022-01-02", 5), (None, "2022-01-31", 95)]
    daily = spark.createDataFrame([(a, d(t), x, d("2022-01-01")) for a, t, x in rows], "act_acct_cd string, dt date, fi_outst_age int, max_inst date")
    churners = C.involuntary_by_end_records(daily, P)
    assert {tuple(r) for r in churners.collect()} == {(JAN, "a", L.FIXED_INVOL, 30), (JAN, "e", L.FIXED_INVOL, 30)}
    base = spark.createDataFrame([(JAN, "a"), (FEB, "a"), (JAN, "b")], "fixed_month date, fixed_account string")
    got = {(r.fixed_month, r.fixed_account): (r.fixed_churn_flag, r.fixed_churn_type_flag, r.churn_tenure_days, r.churn_tenure_segment)
           for r in C.churn_flags(base, churners, late_after=29).collect()}
    none = ("2. Non-churner", "2.Non-Churners", None, "2.Non-Churner")
    assert got == {(JAN, "a"): ("1. Fixed Churner", L.FIXED_INVOL, 30, "1.Late-tenure Churner"), (FEB, "a"): none, (JAN, "b"): none}
    assert C.churn_flags(base, churners, late_after=30).where("churn_tenure_segment = '0.Early-tenure Churner'").count() == 1


def orders(spark, rows):
    return spark.createDataFrame([(i, a, L.ORDER_UNINSTALL, "FINALIZADA", r, d(t)) for i, (a, r, t) in enumerate(rows)],
                                 "order_id long, account_name string, order_type string, order_status string, order_reason string, order_start_date date")


def test_deinstallation_wins(spark):
    base = spark.createDataFrame([(FEB, a, 1, e) for a, e in (("a", 0), ("b", 0), ("c", 0), ("kept", 1), ("both", 0), ("moved", None))],
                                 "fixed_month date, fixed_account string, active_bom int, active_eom int")
    o = orders(spark, [("a", "X", "2022-01-20"), ("b", "X", "2021-12-31"), ("kept", "X", "2022-02-10"), ("both", "X", "2022-02-10"),
                       ("moved", "X", "2022-03-05"), ("moved", "X", "2022-04-05")])
    invol = spark.createDataFrame([(FEB, "both"), (FEB, "c"), (JAN, "a")], "month date, churn_account string")
    got = sorted(tuple(r) for r in C.churners_by_deinstallation(base, o, invol, P).collect())
    # the full join is on the order's period, so January's involuntary "a" becomes February's voluntary one
    assert got == [(FEB, "a", L.FIXED_VOL), (FEB, "both", L.FIXED_VOL), (FEB, "c", L.FIXED_INVOL), (FEB, "moved", L.FIXED_VOL)]


def test_churn_by_order_pads_keys(spark):
    o = orders(spark, [("0000000012", "MOROSIDAD", "2022-02-10"), ("13", "X", "2022-02-10")])
    snap = spark.createDataFrame([("12", d("2022-02-11")), ("000013", d("2022-03-01")), ("013", d("2022-05-01")), ("14", MAR)], "act_acct_cd string, dt date")
    assert [tuple(r) for r in C.churn_by_order(o, snap, P).collect()] == [("12", FEB, L.FIXED_INVOL)]
