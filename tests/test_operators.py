import datetime as dt

from pyspark.sql import functions as F

from churnlens import labels as L
from churnlens.operators import churn as C
from churnlens.operators import drivers as D
from churnlens.operators import snapshot as S
from churnlens.params import Params

D0 = dt.date(2022, 1, 1)


def _days(n):
    return [D0 + dt.timedelta(days=i) for i in range(n)]


def test_repair_overdue_spike_and_gap(spark):
    ages = [10, 11, 30, 13, None, 15, 16]
    rows = [("A", d, a) for d, a in zip(_days(7), ages)] + [("B", D0, 5)]
    df = spark.createDataFrame(rows, "act_acct_cd string, dt date, fi_outst_age int")
    out = {(r.act_acct_cd, r.dt): r.mora_fix for r in S.repair_overdue(df).collect()}
    a = [out[("A", d)] for d in _days(7)]
    assert a == [10, 11, 12, 13, 14, 15, 16]
    # an isolated record has no neighbours: NULL in the Presto form
    assert out[("B", D0)] is None
    out2 = {(r.act_acct_cd, r.dt): r.mora_fix for r in S.repair_overdue(df, isolated_null=False).collect()}
    assert out2[("B", D0)] == 5


def test_repair_is_idempotent_on_clean_series(spark):
    rows = [("A", d, i) for i, d in enumerate(_days(10))]
    df = spark.createDataFrame(rows, "act_acct_cd string, dt date, fi_outst_age int")
    assert all(r.mora_fix == r.fi_outst_age for r in S.repair_overdue(df).collect())


def test_bom_eom_thresholds(spark):
    rows = [("A", dt.date(2022, 1, 1), 90), ("A", dt.date(2022, 2, 1), 90)]
    df = spark.createDataFrame(rows, "act_acct_cd string, dt date, mora_fix int")
    for c in ["act_contact_phone_1", "pd_vo_prod_nm", "pd_tv_prod_nm", "pd_bb_prod_nm", "mix", "tech_flag",
              "bundle_name"]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    for c in ["rgu_vo", "rgu_tv", "rgu_bb", "fi_outst_age", "c_cust_age", "num_rgus", "mora"]:
        df = df.withColumn(c, F.lit(0))
    for c in ["min_inst", "max_inst", "act_cust_strt_dt"]:
        df = df.withColumn(c, F.lit(None).cast("date"))
    df = df.withColumn("avg_mrc", F.lit(0.0)).withColumn("bill", F.lit(0.0))
    b = S.snapshot_side(df, "b")
    e = S.snapshot_side(df, "e")
    # opening keeps overdue <= 90, closing needs < 90
    assert b.count() == 2 and e.count() == 0
    base = S.bom_eom_base(b, e)
    assert sorted((r.active_bom, r.active_eom) for r in base.collect()) == [(1, 0), (1, 0)]


def test_involuntary_needs_both_ages(spark):
    p = Params(invol_days=90)
    rows = [("A", dt.date(2022, 1, 1), 80, 80), ("A", dt.date(2022, 1, 31), 95, 95),
            ("B", dt.date(2022, 1, 1), 80, 80), ("B", dt.date(2022, 1, 31), 95, 10)]
    df = spark.createDataFrame(rows, "act_acct_cd string, dt date, mora_fix int, fi_outst_age int")
    df = (df.withColumn("month", F.trunc("dt", "MM")).withColumn("max_inst", F.lit(D0))
            .withColumn("pd_vo_prod_nm", F.lit("x")).withColumn("pd_bb_prod_nm", F.lit(None).cast("string"))
            .withColumn("pd_tv_prod_nm", F.lit("y")))
    inv = C.involuntary_churn(C.period_facts(df, p), p).collect()
    assert [r.churn_account for r in inv] == ["A"]
    assert inv[0].invol_rgu_churn == 2 and inv[0].churn_tenure_days == 30


def test_merge_involuntary_wins(spark):
    vol = spark.createDataFrame([(D0, "A", L.FIXED_VOL), (D0, "B", L.FIXED_VOL)],
                                "fixed_month date, fixed_account string, vol_churner string")
    inv = spark.createDataFrame([(D0, "A", L.FIXED_INVOL, 2, 10)],
                                "month date, churn_account string, invol_churner string, invol_rgu_churn int, "
                                "churn_tenure_days int")
    mr = spark.createDataFrame([("A", 1), ("B", 3)], "act_acct_cd string, max_rgus_count int")
    got = {r.churn_account: r.fixed_churner_type for r in C.merge_churners(vol, inv, mr).collect()}
    assert got == {"A": L.FIXED_INVOL, "B": L.FIXED_VOL}


def test_contacts_in_window_counts_range(spark):
    p = Params(contact_window_days=60)
    ts = [dt.datetime(2021, 12, 31), dt.datetime(2022, 2, 15), dt.datetime(2022, 3, 1), dt.datetime(2022, 3, 2)]
    rows = [("A", str(i), t) for i, t in enumerate(ts)]
    ev = spark.createDataFrame(rows, "account_id string, interaction_id string, interaction_start_time timestamp")
    got = {r.month: r.contacts for r in D.contacts_in_window(ev, ev, p).collect()}
    # last contact of March is 2 March: 15 Feb, 1 and 2 March are within 60 days, 31 Dec is 61 days back
    assert got[dt.date(2022, 3, 1)] == 3
    assert got[dt.date(2021, 12, 1)] == 1
    assert got[dt.date(2022, 2, 1)] == 2


def test_not_in_with_null_keys_is_anti_join(spark):
    # the null-aware NOT IN of SQL returns nothing when the list has a NULL;
    # the library drops NULL keys and anti-joins instead
    a = spark.createDataFrame([("1",), ("2",)], "k string")
    b = spark.createDataFrame([("1",), (None,)], "k string")
    a.createOrReplaceTempView("a_t")
    b.createOrReplaceTempView("b_t")
    assert spark.sql("SELECT * FROM a_t WHERE k NOT IN (SELECT k FROM b_t)").count() == 0
    assert [r.k for r in a.join(b.where("k IS NOT NULL"), "k", "left_anti").collect()] == ["2"]


def test_phone_match_prefers_first_phone(spark):
    from churnlens.operators.convergence import phone_match
    fx = spark.createDataFrame([("A", "1", "2", "3"), ("B", None, "5", "3"), ("C", "9", None, None)],
                               "act_acct_cd string, act_contact_phone_1 string, act_contact_phone_2 string, "
                               "act_contact_phone_3 string")
    mob = spark.createDataFrame([("2",), ("3",), ("3",)], "num_telefono string")
    got = {r.act_acct_cd: (r.matched_phone, r.phone_priority) for r in phone_match(fx, mob).collect()}
    # an account without a match keeps its first phone
    assert got == {"A": ("2", 2), "B": ("3", 3), "C": ("9", None)}


def test_household_match_keeps_every_member(spark):
    from churnlens.operators.convergence import household_match
    from churnlens.params import Params
    f = spark.createDataFrame([("H", D0, "F2"), ("H", D0, "F1"), ("H", D0, "gone"), ("G", D0, "F3"), (None, D0, "F4")],
                              "household_id string, dt date, act_acct_cd string")
    m = spark.createDataFrame([("H", D0, "M1"), ("H", D0, "M0"), ("K", D0, "M2"), (None, D0, "M3")],
                              "household_id string, dt date, mobile_account string")
    month = Params().grain.trunc(F.lit(D0).cast("date"))
    fixed = spark.createDataFrame([("F1",), ("F2",), ("F3",), ("F4",)], "fixed_account string").withColumn("fixed_month", month)
    mobile = spark.createDataFrame([("M0",), ("M1",), ("M2",), ("M3",)], "mobile_account string").withColumn("mobile_month", month)
    got = sorted((r.household_id, r.side, r.member, r.fmc_fixed, r.fmc_mobile, r.n_fixed, r.n_mobile)
                 for r in household_match(f, m, fixed, mobile).collect())
    assert got == [("H", side, x, "F1", "M0", 2, 2) for side, x in (("fixed", "F1"), ("fixed", "F2"), ("mobile", "M0"), ("mobile", "M1"))]


def test_union_history_and_backfill(spark):
    from churnlens.sources.io import backfill_product, union_history
    a = spark.createDataFrame([("1", 2021)], "contrato string, anio int")
    b = spark.createDataFrame([("2", 2022, "x")], "cto string, year int, extra string")
    u = union_history([(a, {"contrato": "account", "anio": "year"}, F.col("year") >= 2021),
                       (b, {"cto": "account", "year": "year", "extra": "extra"}, None)])
    assert sorted((r.account, r.year, r.extra) for r in u.collect()) == [("1", 2021, None), ("2", 2022, "x")]
    snap = spark.createDataFrame([("A", dt.date(2022, 1, 5), "VO1"), ("A", dt.date(2022, 2, 5), None),
                                  ("A", dt.date(2021, 12, 5), None)], "act_acct_cd string, dt date, pd_vo_prod_nm string")
    got = {r.dt: r.pd_vo_prod_nm for r in backfill_product(snap, "pd_vo_prod_nm", "2022-01-01", "2022-01-01").collect()}
    assert got == {dt.date(2022, 1, 5): "VO1", dt.date(2022, 2, 5): "VO1", dt.date(2021, 12, 5): None}


def test_active_by_mrc_keeps_young_or_paying(spark):
    snap = spark.createDataFrame([("A", dt.date(2022, 1, 5), 0.0, dt.date(2020, 1, 1)),
                                  ("B", dt.date(2022, 1, 5), 0.0, dt.date(2022, 1, 1)),
                                  ("C", dt.date(2022, 1, 5), 10.0, dt.date(2020, 1, 1))],
                                 "act_acct_cd string, dt date, fi_bill_amt_m0 double, act_cust_strt_dt date")
    assert sorted(r.act_acct_cd for r in S.active_by_mrc(snap).collect()) == ["B", "C"]


def _orders(spark, rows):
    return spark.createDataFrame(rows, "order_id long, account_name string, order_type string, order_status string, "
                                       "order_reason string, order_start_date date")


def test_match_churn_order_latest_within_window(spark):
    orders = _orders(spark, [(1, "A", "DESINSTALACION", "FINALIZADA", "MOROSIDAD", dt.date(2022, 1, 10)),
                             (2, "A", "DESINSTALACION", "FINALIZADA", "VOLUNTARIO", dt.date(2022, 3, 1)),
                             (3, "A", "DESINSTALACION", "FINALIZADA", "VOLUNTARIO", dt.date(2022, 6, 1)),
                             (4, "B", "DESINSTALACION", "FINALIZADA", "VOLUNTARIO", dt.date(2021, 1, 1))])
    crm = spark.createDataFrame([("A", dt.date(2022, 4, 15)), ("B", dt.date(2022, 4, 15))],
                                "account string, churn_date date")
    got = [(r.account, r.order_id, r.churn_type) for r in C.match_churn_order(crm, orders).collect()]
    assert got == [("A", 2, L.FIXED_VOL)]


def test_churn_by_order_last_order_and_window(spark):
    orders = _orders(spark, [(1, "A", "DESINSTALACION", "FINALIZADA", "VOLUNTARIO", dt.date(2022, 1, 10)),
                             (2, "A", "DESINSTALACION", "ANULADA", "MOROSIDAD", dt.date(2022, 2, 10)),
                             (3, "B", "DESINSTALACION", "FINALIZADA", "VOLUNTARIO", dt.date(2022, 1, 10)),
                             (4, "C", "INSTALACION", "FINALIZADA", None, dt.date(2022, 1, 10))])
    snap = spark.createDataFrame([("A", dt.date(2022, 3, 1)), ("B", dt.date(2022, 6, 1))], "act_acct_cd string, dt date")
    got = {r.account: r.churn_type for r in C.churn_by_order(orders, snap).collect()}
    # any non-null status counts by default; B's last snapshot is too late
    assert got == {"A": L.FIXED_INVOL}
    got2 = {r.account: r.churn_type for r in C.churn_by_order(orders, snap, exclude_status=L.ORDER_CANCELLED).collect()}
    assert got2 == {}


def test_voluntary_by_lines(spark):
    cancels = spark.createDataFrame([("A", dt.date(2022, 1, 5)), ("A", dt.date(2022, 1, 5)),
                                     ("B", dt.date(2022, 1, 5)), ("B", dt.date(2022, 1, 1))],
                                    "src_account_id string, cancel_date date")
    snap = spark.createDataFrame([("A", dt.date(2022, 1, 4), "v", "t", None, 95),
                                  ("B", dt.date(2022, 1, 4), "v", "t", None, 10)],
                                 "act_acct_cd string, dt date, pd_vo_prod_nm string, pd_tv_prod_nm string, "
                                 "pd_bb_prod_nm string, fi_outst_age int")
    got = {r.account: r.churn_type for r in C.voluntary_by_lines(cancels, snap).collect()}
    assert got == {"A": "2.Fixed Mixed Churner"}


def test_account_history_and_gain_movement(spark):
    from churnlens.operators.movement import gain_movement
    from churnlens.operators.quality import account_history
    snap = spark.createDataFrame([("A", dt.date(2022, 1, 2)), ("B", D0), ("A", D0)], "act_acct_cd string, dt date")
    assert [r.dt for r in account_history(snap, "A").collect()] == [D0, dt.date(2022, 1, 2)]
    # a change needs both sides of the product; a gain is new when installed in its period
    rows = [("kept", 1, 1, D0, 1, 0, None, 1, 1, 1), ("new", 0, 1, D0, None, None, None, 1, 0, 1),
            ("back", 0, 1, dt.date(2021, 11, 5), None, None, None, 1, 1, 0), ("unknown", 0, 1, None, None, None, None, 1, 1, 0),
            ("gone", 1, 0, None, 1, 1, 0, None, None, None)]
    base = spark.createDataFrame(rows, "fixed_account string, active_bom int, active_eom int, e_max_inst date, b_rgu_vo int, b_rgu_tv int, "
                                       "b_rgu_bb int, e_rgu_vo int, e_rgu_tv int, e_rgu_bb int")
    base = base.withColumn("fixed_month", F.lit(dt.date(2022, 1, 1)))
    got = {r.fixed_account: (r.gain_movement, r.dif_rgu_vo, r.dif_rgu_tv, r.dif_rgu_bb) for r in gain_movement(base).collect()}
    assert got == {"kept": (None, 0, 1, 0), "new": (L.GAIN_NEW, 0, 0, 0), "back": (L.GAIN_COMEBACK, 0, 0, 0),
                   "unknown": (None, 0, 0, 0), "gone": (None, 0, 0, 0)}


def test_period_summary_first_day_and_last_record(spark):
    p = Params(invol_days=90)
    rows = [("A", dt.date(2022, 1, 1), 10, 10, "v", None, None), ("A", dt.date(2022, 1, 20), 95, 95, None, "t", None),
            ("A", dt.date(2022, 2, 3), None, None, None, None, "b")]
    df = spark.createDataFrame(rows, "act_acct_cd string, dt date, mora_fix int, fi_outst_age int, "
                                     "pd_vo_prod_nm string, pd_tv_prod_nm string, pd_bb_prod_nm string")
    for c in ["act_contact_phone_1", "mix", "tech_flag", "bundle_name"]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    for c in ["rgu_vo", "rgu_tv", "rgu_bb", "c_cust_age", "num_rgus", "mora"]:
        df = df.withColumn(c, F.lit(0))
    for c in ["min_inst", "max_inst", "act_cust_strt_dt", "lst_pymt_dt"]:
        df = df.withColumn(c, F.lit(D0))
    df = df.withColumn("avg_mrc", F.lit(0.0)).withColumn("bill", F.lit(0.0)).withColumn("month", F.trunc("dt", "MM"))
    s = {r.month: r for r in S.period_summary(df, p).collect()}
    jan, feb = s[dt.date(2022, 1, 1)], s[dt.date(2022, 2, 1)]
    assert jan.first_day.date == D0 and jan.last.fix == 95 and jan.any_below == 1 and jan.invol_rgu_churn == 2
    assert feb.first_day is None  # no snapshot on the 1st of February
    assert jan.first_products.vo == "v"


def test_first_time_resolution_across_period_boundary(spark):
    from churnlens.operators.kpi import first_time_resolution
    p = Params(ftr_days=14)
    calls = spark.createDataFrame([("A", "1", dt.datetime(2022, 1, 31)), ("A", "2", dt.datetime(2022, 2, 2)),
                                   ("B", "3", dt.datetime(2022, 1, 10)), ("B", "4", dt.datetime(2022, 1, 30))],
                                  "account_id string, interaction_id string, interaction_start_time timestamp")
    got = {(r.account, r.month): (r.resolved, r.billing_calls) for r in first_time_resolution(calls, p).collect()}
    # A's call of 31 Jan is followed 2 days later (in February): not resolved; B's next call is 20 days later
    assert got == {("A", dt.date(2022, 1, 1)): (0, 1), ("A", dt.date(2022, 2, 1)): (1, 1), ("B", dt.date(2022, 1, 1)): (2, 2)}


def test_first_time_resolution_same_day_and_same_id(spark):
    from churnlens.operators.kpi import first_time_resolution
    calls = spark.createDataFrame([("A", "1", dt.datetime(2022, 1, 5)), ("A", "2", dt.datetime(2022, 1, 5)),
                                   ("B", "7", dt.datetime(2022, 1, 5)), ("B", "7", dt.datetime(2022, 1, 6)),
                                   (None, "8", dt.datetime(2022, 1, 6))],
                                  "account_id string, interaction_id string, interaction_start_time timestamp")
    got = {r.account: (r.resolved, r.billing_calls) for r in first_time_resolution(calls, Params(ftr_days=14)).collect()}
    # a day of two calls counts with one of them; the same id on two days is one call and no repeat of itself
    assert got == {"A": (1, 2), "B": (1, 1)}


INTER = "account_id string, account_type string, interaction_id string, interaction_start_time timestamp, " \
        "interaction_purpose_descrip string, interaction_status string"


def test_void_interactions_before_or_after_the_daily_dedupe(spark):
    ev = spark.createDataFrame([("A", "RESIDENCIAL", "1", dt.datetime(2022, 1, 5, 8), "AVERIAS", "CERRADA"),
                                ("A", "RESIDENCIAL", "2", dt.datetime(2022, 1, 5, 9), "AVERIAS", "CANCELADA"),
                                ("B", "EMPRESA", "3", dt.datetime(2022, 1, 5, 9), "AVERIAS", "CERRADA")], INTER)
    assert [r.interaction_id for r in D.dedupe_interactions(ev).collect()] == ["2"]
    assert [r.interaction_id for r in D.dedupe_interactions(ev, void=L.VOID_STATUSES).collect()] == ["1"]
    assert D.calls(D.dedupe_interactions(ev)).count() == 1  # cancelled calls anchor the contact windows
    assert D.calls(D.dedupe_interactions(ev), void=L.VOID_STATUSES).count() == 0


def test_contact_ids_on_two_days_count_once(spark):
    ev = spark.createDataFrame([("A", "1", dt.datetime(2022, 1, 5)), ("A", "1", dt.datetime(2022, 1, 6)),
                                ("A", "2", dt.datetime(2022, 1, 7))],
                               "account_id string, interaction_id string, interaction_start_time timestamp")
    assert [r.contacts for r in D.contacts_in_window(ev, ev, Params()).collect()] == [2]


def test_mounting_bills_without_an_earlier_bill_date(spark):
    o = dt.date(2021, 12, 1)
    days = spark.createDataFrame([("A", dt.date(2022, 1, 1), o, None), ("A", dt.date(2022, 2, 1), o, o),
                                  ("A", dt.date(2022, 3, 1), o, o), ("B", dt.date(2022, 1, 1), o, o),
                                  ("B", dt.date(2022, 2, 1), o, None)], "account string, month date, o date, b date")
    assert sorted((r.account, r.month.month) for r in D.mounting_bills(days).collect()) == [("A", 2), ("A", 3)]
    assert sorted((r.account, r.month.month) for r in D.mounting_bills(days, periods=2).collect()) == [("A", 3)]


def test_channel_mapping_attaches_the_group(spark):
    orders = spark.createDataFrame([("A", "INSTALACION", "FINALIZADA", "WEB", dt.date(2022, 1, 5), 1),
                                    ("B", "INSTALACION", "FINALIZADA", "OTHER", dt.date(2022, 1, 5), 2)],
                                   "account_name string, order_type string, order_status string, channel_desc string, "
                                   "order_start_date date, order_id long")
    groups = spark.createDataFrame([("WEB", "Digital")], "channel string, channel_group string")
    got = {r.account: r.channel_group for r in D.sales_channel(orders, mapping=groups).collect()}
    assert got == {"A": "Digital", "B": None}


def test_all_null_needs_every_day_and_intermittent_starts_without_products(spark):
    from churnlens.operators.quality import all_null_accounts, intermittent
    rows = [("A", dt.date(2022, 2, d), None, 0.0, 0.0, None if d < 9 else "x") for d in range(1, 29)]
    rows += [("B", dt.date(2022, 2, d), 0.0, 0.0, 0.0, "x" if d < 9 else None) for d in range(1, 28)]
    snap = spark.createDataFrame(rows, "act_acct_cd string, dt date, fi_vo_mrc_amt double, fi_tv_mrc_amt double, "
                                       "fi_bb_mrc_amt double, pd_vo_prod_nm string")
    snap = snap.withColumn("pd_tv_prod_nm", F.lit(None).cast("string")).withColumn("pd_bb_prod_nm", F.lit(""))
    assert [(r.account, r.days) for r in all_null_accounts(snap).collect()] == [("A", 28)]
    assert [r.intermittent_accounts for r in intermittent(snap).collect()] == [1]


def test_last_order_without_a_reason_is_no_churn(spark):
    orders = _orders(spark, [(1, "A", "DESINSTALACION", "FINALIZADA", None, dt.date(2022, 1, 10))])
    snap = spark.createDataFrame([("A", dt.date(2022, 1, 12))], "act_acct_cd string, dt date")
    assert C.churn_by_order(orders, snap).count() == 0


def test_repeated_and_blank_register_rows(spark):
    from churnlens.operators.mobile import clean_register
    row = (dt.date(2022, 1, 1), "8.1", "77", "600", "a@x", "1,5", "01/02/2021", "Residencial")
    reg = spark.createDataFrame([row, row, (row[0], "", *row[2:]), (row[0], None, *row[2:])],
                                "fecha_parque date, id_abonado string, contrato string, num_telefono string, nom_email string, "
                                "renta string, fch_activacion string, des_segmento_cliente string")
    assert [r.id_abonado for r in clean_register(reg).collect()] == ["81"]


def test_retention_funnel_counts_master_accounts_with_padded_keys(spark):
    from churnlens.operators.billing import retention_funnel
    req = spark.createDataFrame([("0000000012", dt.date(2022, 1, 5), "CONTACTO EFECTIVO", "RETENIDO"),
                                 ("99", dt.date(2022, 1, 5), "CONTACTO EFECTIVO", None)],
                                "contrato string, request_date date, contactabilidad string, solucion string")
    master = spark.createDataFrame([("12", dt.date(2022, 1, 1), 1.5), ("12", dt.date(2022, 1, 1), 0.5), ("13", dt.date(2022, 1, 1), 1.0)],
                                   "fixed_account string, month date, b_total_rgus double")
    r = retention_funnel(req, master).collect()
    assert [(x.requests, x.located, x.retained, x.request_rgus) for x in r] == [(1, 1, 1, 2.0)]


def two_plan_snapshot(spark):
    cols = ("act_acct_cd string, dt date, act_cust_typ string, act_acct_stat string, pd_vo_prod_nm string, pd_tv_prod_nm string, "
            "pd_bb_prod_nm string, fi_vo_mrc_amt double, fi_tv_mrc_amt double, fi_bb_mrc_amt double, fi_bill_amt_m0 double, "
            "fi_outst_age int, oldest_unpaid_bill_dt date, lst_pymt_dt date, c_cust_age int, act_cust_strt_dt date, "
            "act_acct_inst_dt date, act_contact_phone_1 string")

    def row(acct, day, vo=None, tv=None, bb=None, bill=10.0, age=None):
        return (acct, day, "RESIDENCIAL", "ACTIVO", vo, tv, bb, 1.0, 1.0, 1.0, bill, age, None, None, 3, dt.date(2021, 1, 1),
                dt.date(2021, 1, 1), "1")
    jan, feb, mar = (dt.date(2022, m, 1) for m in (1, 2, 3))
    data = [row("A", jan, vo="v", bill=10.0), row("A", jan, tv="t", bill=20.0), row("A", jan, tv="t", bill=20.0), row("A", feb, bb="b", bill=5.0),
            row("B", feb, vo="v", bill=1.0), row("B", feb, bb="b", bill=2.0), row("C", jan, vo="v"), row("C", feb, vo="v"),
            row("C", feb, vo="v", age=5), row("D", mar, vo="v")]
    return spark.createDataFrame(data, cols)


def test_two_plan_rows_of_a_day_are_kept(spark):
    from churnlens.plans.fixed import fixed_table
    got = fixed_table(two_plan_snapshot(spark), Params()).collect()
    at = lambda a, m: sorted((r.b_plan, r.b_bill_amt, r.e_plan, r.e_bill_amt, r.main_movement)
                             for r in got if r.fixed_account == a and r.fixed_month == dt.date(2022, m, 1))
    # the exact copy is one row; each opening row meets the closing row
    assert at("A", 1) == [("-t-", 20.0, "--b", 5.0, L.MM_SAME), ("v--", 10.0, "--b", 5.0, L.MM_SAME)]
    lost = [r for r in got if r.fixed_account == "B" and r.fixed_month == dt.date(2022, 2, 1)]
    assert sorted(r.b_plan for r in lost) == ["--b", "v--"]
    assert {(r.fixed_churner_type, r.max_rgus_count, r.fixed_rgu_churn) for r in lost} == {(L.FIXED_VOL, 2, 2)}
    assert len([r for r in got if r.fixed_account == "C" and r.fixed_month == dt.date(2022, 1, 1)]) == 2


def test_last_day_counts_its_largest_ages(spark):
    rows = [("A", D0, 1), ("A", dt.date(2022, 1, 20), None), ("A", dt.date(2022, 1, 20), 95), ("A", dt.date(2022, 1, 20), 3)]
    df = spark.createDataFrame(rows, "act_acct_cd string, dt date, fi_outst_age int").withColumn("mora_fix", F.col("fi_outst_age"))
    for c in [src for src, _ in S._SIDE_COLS if src not in df.columns] + ["pd_vo_prod_nm", "lst_pymt_dt"]:
        df = df.withColumn(c, F.lit(None).cast("date" if c in ("min_inst", "max_inst", "lst_pymt_dt") else "string"))
    got = S.period_summary(df.withColumn("month", F.trunc("dt", "MM")), Params()).first()
    assert (got.last.fix, got.last.raw, got.last.d) == (95, 95, dt.date(2022, 1, 20))


def test_fan_out_counts_lines_times_plan_rows(spark):
    from churnlens.operators.convergence import fmc_base
    fixed = spark.createDataFrame([("1", D0, 1, 1, 10), ("1", D0, 1, 1, 20), ("2", D0, 1, 1, 5), ("2", D0, 1, 1, 6)],
                                  "fixed_account string, fixed_month date, active_bom int, active_eom int, bill int")
    mobile = spark.createDataFrame([(f"m{i}", D0, 1, 1, "1") for i in range(3)] + [("m9", D0, 1, 1, None)],
                                   "mobile_account string, mobile_month date, mobile_active_bom int, mobile_active_eom int, fmc_account string")
    got = sorted((r.fixed_account or "", r.mobile_account or "", r.bill or 0, r.contracts_fix) for r in fmc_base(fixed, mobile).collect())
    assert got == [("", "m9", 0, 1)] + [("1", f"m{i}", b, 6) for i in range(3) for b in (10, 20)] + [("2", "", 5, 2), ("2", "", 6, 2)]
