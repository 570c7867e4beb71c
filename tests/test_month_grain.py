"""The fixed pipeline at the production default grain (month) on hand-made
daily rows: movements, involuntary churn with both ages, voluntary churn."""
import datetime as dt

from churnlens import labels as L
from churnlens.params import Params
from churnlens.plans.fixed import fixed_stages

COLS = ("act_acct_cd string, dt date, act_cust_typ string, act_acct_stat string, pd_vo_prod_nm string, "
        "pd_tv_prod_nm string, pd_bb_prod_nm string, fi_vo_mrc_amt double, fi_tv_mrc_amt double, "
        "fi_bb_mrc_amt double, fi_bill_amt_m0 double, fi_outst_age int, oldest_unpaid_bill_dt date, "
        "lst_pymt_dt date, c_cust_age int, act_cust_strt_dt date, act_acct_inst_dt date, "
        "act_contact_phone_1 string")


def row(acct, day, vo, tv, bb, age, bill=30.0):
    start = dt.date(2020, 1, 1)
    oldest = None if age is None else day - dt.timedelta(days=age)
    return (acct, day, "RESIDENCIAL", "ACTIVO", vo, tv, bb, 10.0, 10.0, 10.0, bill, age, oldest, start, 24,
            start, start, "600")


def test_monthly_movements_and_churn(spark):
    d = dt.date
    rows = [
        # A: BB+TV on 1 Jan, BB only on 1 Feb and 1 Mar -> Jan downsell, Feb same
        row("A", d(2022, 1, 1), None, "tv", "bb", None), row("A", d(2022, 2, 1), None, None, "bb", None),
        row("A", d(2022, 3, 1), None, None, "bb", None),
        # B: 10 days overdue on 1 Jan, 95 on its last January record, 96 on 1 Feb -> Jan involuntary
        row("B", d(2022, 1, 1), "vo", None, None, 10), row("B", d(2022, 1, 31), "vo", None, None, 95),
        row("B", d(2022, 2, 1), "vo", None, None, 96),
        # C: present 1 Jan only -> Jan voluntary churner (loss)
        row("C", d(2022, 1, 1), "vo", "tv", "bb", None),
        # D: 90 on 1 Jan passes the opening limit (<= 90) but 90 on 1 Feb fails the closing limit (< 90)
        row("D", d(2022, 1, 1), "vo", None, None, 90), row("D", d(2022, 1, 15), "vo", None, None, 104),
        row("D", d(2022, 2, 1), "vo", None, None, 90),
    ]
    snap = spark.createDataFrame(rows, COLS)
    t = {(r.fixed_account, r.fixed_month): r for r in fixed_stages(snap, Params()).table.collect()}
    jan, feb = d(2022, 1, 1), d(2022, 2, 1)
    assert t[("A", jan)].main_movement == L.MM_DOWNSELL and t[("A", jan)].fixed_rgu_churn == 1
    assert t[("A", feb)].main_movement == L.MM_SAME
    assert t[("B", jan)].active_eom == 0 and t[("B", jan)].fixed_churner_type == L.FIXED_INVOL
    assert t[("C", jan)].fixed_churner_type == L.FIXED_VOL and t[("C", jan)].main_movement == L.MM_LOSS
    assert t[("C", jan)].fixed_rgu_churn == 3
    # D: in the January opening, not in the January closing; its raw January
    # ages never drop below 90, so it is a voluntary churner
    assert t[("D", jan)].active_bom == 1 and t[("D", jan)].active_eom == 0
    assert t[("D", jan)].fixed_churner_type == L.FIXED_VOL
    assert ("B", feb) not in t or t[("B", feb)].active_bom == 0


def test_dedupe_collapses_exact_copies_and_drops_blank_keys(spark):
    d = dt.date
    rows = [row("A", d(2022, 1, 1), "vo", None, None, None), row("A", d(2022, 2, 1), "vo", "tv", None, None)]
    copies = rows + rows + [row("", d(2022, 1, 1), "vo", None, None, None)]
    clean = {(r.fixed_account, r.fixed_month, r.main_movement)
             for r in fixed_stages(spark.createDataFrame(rows, COLS), Params()).table.collect()}
    dup = fixed_stages(spark.createDataFrame(copies, COLS), Params(), dedupe=True).table.collect()
    assert {(r.fixed_account, r.fixed_month, r.main_movement) for r in dup} == clean
    assert len(dup) == len(clean)
