"""Hand-made rows for the list patch, debt bands, gross adds, payment sources, early contacts, order match and KPIs."""
import datetime as dt

from pyspark.sql import functions as F

from churnlens import labels as L
from churnlens.operators import billing as B
from churnlens.operators import convergence as V
from churnlens.operators import drivers as D
from churnlens.operators import kpi as K
from churnlens.operators.churn import match_churn_order
from churnlens.operators.mobile import voluntary_flag_count
from churnlens.operators.movement import gross_adds

MAR, APR = dt.date(2022, 3, 1), dt.date(2022, 4, 1)


def day(text):
    return dt.date.fromisoformat(text)


def test_patch_has_three_states(spark):
    cols = ("final_account string, month date, b_mix string, e_mix string, mobile_active_bom int, mobile_active_eom int, "
            "active_eom int, b_fmc_type string, e_fmc_type string, b_fmc_segment string, e_fmc_segment string")
    own = ("B", "E", "SB", "SE")
    rows = [("listed", MAR, "1P", "2P", 0, 0, 1, *own), ("listed mobile", MAR, None, None, 1, 1, 0, *own),
            ("listed gone", MAR, "3P", "3P", 0, 0, 0, *own), ("unlisted", MAR, "1P", "1P", 0, 0, 1, *own),
            ("unlisted mobile", MAR, None, None, 1, 1, 0, *own), ("unlisted off", MAR, None, None, 0, 0, 0, *own),
            ("unlisted unknown", MAR, None, None, None, None, 0, *own), ("listed", APR, None, None, 0, 1, 0, *own)]
    listed = spark.createDataFrame([("listed", MAR), ("listed mobile", MAR), ("listed gone", MAR)], "account string, month date")
    got = {(r.final_account, r.month): (r.fmc_listed, r.b_fmc_type_final, r.e_fmc_type_final, r.b_fmc_segment_final, r.e_fmc_segment_final)
           for r in V.patch_fmc(spark.createDataFrame(rows, cols), listed).collect()}
    mobile, both = L.FMC_MOBILE_ONLY, "Soft/Hard FMC"
    assert got == {
        ("listed", MAR): (1, both, both, "P2", "P3"), ("listed mobile", MAR): (1, mobile, mobile, L.SEG_P1_MOBILE, L.SEG_P1_MOBILE),
        ("listed gone", MAR): (1, both, "E", "P4", "P4"), ("unlisted", MAR): (0, *own),
        ("unlisted mobile", MAR): (0, "B", mobile, "SB", "SE"), ("unlisted off", MAR): (0, None, None, None, None),
        ("unlisted unknown", MAR): (0, *own), ("listed", APR): (0, *own)}


def test_debt_bands_use_both_ages(spark):
    rows = [("a", "2022-03-05", "2022-03-01", 70, 95), ("a", "2022-03-06", "2022-03-01", 22, None), ("b", "2022-03-05", "2022-03-01", 70, 60),
            ("c", "2022-03-05", "2022-04-01", None, None), ("c", "2022-04-02", None, 28, 92), ("d", "2022-03-05", "2022-03-01", 91, 90)]
    snap = spark.createDataFrame([(a, day(d), day(b) if b else None, f, s) for a, d, b, f, s in rows],
                                 "act_acct_cd string, dt date, bill_dt_m0 date, fi_outst_age_final int, fi_outst_age int")
    got = sorted((r.month, r.day_one, r.soft_dx, r.backlog, r.hard_dx, r.accounts, r.billed) for r in B.debt_bands(snap).collect())
    assert got == [(MAR, 0, 0, 0, 0, 1, 0), (MAR, 0, 0, 0, 1, 1, 0), (MAR, 0, 0, 1, 0, 1, 1), (MAR, 1, 0, 0, 1, 1, 1), (APR, 0, 1, 0, 1, 1, 1)]


def test_gross_adds_of_the_last_day(spark):
    rows = [("a", "2022-03-31", "2022-03-10", "V", "B", None, 10.4, 5.0, 0.0), ("a", "2022-03-31", "2022-03-10", "V", "B", None, 20.4, 5.0, 0.0),
            ("a", "2022-03-30", "2022-03-10", "V", "B", "T", 10.0, 5.0, 1.0), ("b", "2022-03-31", "2022-02-28", "V", None, None, 1.0, 0.0, 0.0),
            ("c", "2022-03-31", "2022-03-31", None, "", None, 1.0, 0.0, 0.0), ("d", "2022-03-31", "2022-03-01", None, None, "T", 0.0, 0.0, 7.0),
            ("d", "2022-03-31", "2022-03-01", None, None, "T2", 0.0, 0.0, 7.0)]
    snap = spark.createDataFrame([(a, day(d), day(s), *r, None) for a, d, s, *r in rows],
                                 "act_acct_cd string, dt date, act_cust_strt_dt date, pd_vo_prod_nm string, pd_bb_prod_nm string, "
                                 "pd_tv_prod_nm string, fi_vo_mrc_amt double, fi_bb_mrc_amt double, fi_tv_mrc_amt double, fi_outst_age int")
    r = gross_adds(snap).collect()
    assert [tuple(x) for x in r] == [(MAR, 3, 1, 1, 2, 15.0, 5.0, 14.0)]


def test_payment_sources(spark):
    pay = spark.createDataFrame([("d1", "7", 10.0), ("d1", "7", 10.0), ("d2", "7", 5.5), ("d3", "-1", 9.0), ("d4", "8", 1.0), ("d5", "9", 2.0)],
                                "payment_doc_id string, invoice_id string, payment_amt_local double")
    bills = spark.createDataFrame([("7", "c", MAR, day("2022-03-04")), ("9", "e", MAR, day("2022-03-04"))],
                                  "first_bill string, contrato string, month date, bill_date date")
    moves = spark.createDataFrame([("0000000007", day("2022-03-09"), 8.0), ("0000000007", day("2022-03-08"), 8.3), ("0000000008", MAR, 1.0)],
                                  "fact_aplica string, fecha_mov date, monto_fact double")
    got = [tuple(r) for r in B.reconcile_payments(pay, bills, moves).select(
        "invoice", "contrato", "payment_total", "first_movement", "movement_total", "difference").collect()]
    assert got == [("0000000007", "c", 15.5, day("2022-03-08"), 16.0, -0.5)]


def test_contacts_belong_to_the_last_start(spark):
    starts = spark.createDataFrame([("a", day("2022-01-10")), ("a", day("2022-03-01")), ("a", day("2022-03-01")), ("b", day("2022-01-05")),
                                    (None, MAR)], "account string, start date")
    calls = [("a", "1", "2022-01-09"), ("a", "2", "2022-01-10"), ("a", "2", "2022-01-10"), ("a", "3", "2022-01-31"), ("a", "4", "2022-02-01"),
             ("a", "5", "2022-03-01"), ("c", "6", "2022-01-09"), (None, "7", "2022-01-09")]
    events = spark.createDataFrame([(a, i, dt.datetime.fromisoformat(d)) for a, i, d in calls],
                                   "account_id string, interaction_id string, interaction_start_time timestamp")
    bands = (("d21", "day", 0, 21), ("m1", "period", 1, 6))
    got = {(r.account, r.start, r.month): (r.d21, r.m1) for r in D.contacts_after_start(events, starts, bands).collect()}
    jan = dt.date(2022, 1, 1)
    assert got == {("a", day("2022-01-10"), jan): (2, 1), ("a", MAR, MAR): (1, 0), ("b", day("2022-01-05"), jan): (0, 0)}
    by_event = {(r.account, r.start, r.month): (r.d21, r.m1) for r in D.contacts_after_start(events, starts, bands, anchor="event").collect()}
    assert by_event == {("a", day("2022-01-10"), jan): (2, 0), ("a", day("2022-01-10"), dt.date(2022, 2, 1)): (0, 1), ("a", MAR, MAR): (1, 0)}


def test_churn_takes_the_latest_order(spark):
    orders = spark.createDataFrame([(i, a, "DESINSTALACION", "FINALIZADA", r, day(d)) for i, a, r, d in (
        (1, "x", "MOROSIDAD", "2022-01-05"), (2, "x", "VOLUNTARIO", "2022-02-05"), (3, "x", "VOLUNTARIO", "2022-02-05"),
        (4, "x", "MOROSIDAD", "2022-05-01"), (5, "y", "MOROSIDAD", "2021-01-01"))],
        "order_id long, account_name string, order_type string, order_status string, order_reason string, order_start_date date")
    crm = spark.createDataFrame([("x", day("2022-03-01")), ("x", day("2022-05-01")), ("x", day("2022-01-04")), ("y", MAR)], "account string, churn_date date")
    got = {(r.account, r.churn_date): r.order_id for r in match_churn_order(crm, orders).collect()}
    assert got == {("x", day("2022-03-01")): 3, ("x", day("2022-05-01")): 4}


def test_voluntary_flags(spark):
    rows = [(MAR, "1.0", "B2C", "2022", "nan"), (MAR, "1.0", "B2C", "2022", "2022-31-02"), (MAR, "1.0", "B2C", "2022", "2022-30-01"),
            (MAR, "0.0", "B2C", "2022", "nan"), (MAR, "1.0", "B2B", "2022", "nan"), (MAR, "1.0", "B2C", "nan", "nan")]
    lines = spark.createDataFrame(rows, "dt date, voluntary_flg string, biz_unit_d string, inv_paymt_dt string, stopdate_accountno string")
    assert [tuple(r) for r in voluntary_flag_count(lines, "2022-31-01").collect()] == [(MAR, 2)]


def test_summary_by_segment_counts_an_account_in_each(spark):
    rows = [(MAR, "a", "s1", "x", None), (MAR, "a", "s1", None, "y"), (MAR, "a", "s2", None, None), (MAR, "b", None, "x", None),
            (MAR, None, "s1", "x", None)]
    m = spark.createDataFrame([(*r, "Non Churner") for r in rows], "month date, fixed_account string, seg string, f string, g string, final_churn_flag string")
    got = {r.seg: (r.activebase, r.f, r.g) for r in D.driver_summary(m, ["f", "g"], by=["seg"]).collect()}
    assert got == {"s1": (1, 1, 1), "s2": (1, 0, 0), None: (1, 1, 0)}


def test_kpi_sums_and_overall(spark):
    master = spark.createDataFrame([(MAR, "1", 2, 3, "1", L.MM_NEW), (MAR, "1", 2, 3, "1", L.MM_SAME), (MAR, "2", 1, 1, None, L.MM_SAME), (MAR, None, 1, None, None, None)],
                                   "month date, fixed_account string, contracts_fix long, b_num_rgus int, increase_flag string, main_movement string")
    counts = spark.createDataFrame([("1", MAR, 3, 4, 5), ("3", MAR, 9, 9, 9)], "account string, month date, tickets long, calls long, billing long")
    ftr = spark.createDataFrame([("2", MAR, 1, 2)], "account string, month date, resolved long, billing_calls long")
    r = K.kpi_sums(master, counts, ftr).first().asDict()
    assert r == {"month": MAR, "rgus": 7.0, "tickets": 3.0, "calls": 4.0, "variation_calls": 10, "variations": 1, "resolved": 1.0,
                 "billing_calls": 2.0, "gross_adds": 1, "active_base": 2}
    dims = [F.lit(x).alias(n) for n, x in (("month", MAR), *((c, "x") for c in K.CX_DIMS[1:-1]))]
    rows = spark.createDataFrame([("ratio", 0.5, 1.0, 2.0), ("zero", None, 0.0, 0.0), ("plain", 3.0, None, None)],
                                 "kpi_name string, kpi_meas double, kpi_num double, kpi_den double").select(*dims, "*")
    got = {r.kpi_name: (r.kpi_meas, r.kpi_numm, r.kpi_denn, r.ref_year, r.ref_mo) for r in K.cx_overall(rows).collect()}
    assert got == {"ratio": (0.5, 1.0, 2.0, 2022, 3), "zero": (None, 0.0, 0.0, 2022, 3), "plain": (3.0, 0.0, 0.0, 2022, 3)}
