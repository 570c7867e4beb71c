"""FMC rules on hand-made rows: one row per main branch."""
import datetime as dt

from pyspark.sql import functions as F

from churnlens import labels as L
from churnlens.operators import convergence as V

M = dt.date(2022, 1, 1)
FIXED = ("fixed_month date, fixed_account string, active_bom int, active_eom int, b_mix string, e_mix string, "
         "b_num_rgus int, e_num_rgus int, b_tech_flag string, e_tech_flag string, b_bill_amt double, "
         "e_bill_amt double, fixed_churner_type string, fixed_rgu_churn int, fixed_rejoiner_type string, "
         "main_movement string, b_plan string, e_plan string, b_fixed_tenure_segment string, "
         "e_fixed_tenure_segment string")
MOBILE = ("mobile_month date, mobile_account string, mobile_active_bom int, mobile_active_eom int, "
          "fmc_account string, b_fixed_contract string, e_fixed_contract string, b_email string, e_email string, "
          "b_mobile_mrc double, e_mobile_mrc double, mobile_churn_type string, mobile_rgu_churn int, "
          "mobile_rejoiner_type string, mobile_movement_flag string, b_mobile_tenure_segment string, "
          "e_mobile_tenure_segment string")


def fx(acct, ab, ae, mix_b, mix_e, nb, ne, churn=None, mm=L.MM_SAME):
    return (M, acct, ab, ae, mix_b, mix_e, nb, ne, "HFC", "HFC", 50.0, 50.0, churn, 0, None, mm, "p", "p",
            "Late Tenure", "Late Tenure")


def mb(line, ab, ae, contract, email=None, churn=None):
    return (M, line, ab, ae, contract or line, contract, contract, email, email, 10.0, 10.0, churn,
            1 if churn else 0, None, None, None, None)


def test_fmc_status_type_segment_and_churn(spark):
    fixed = spark.createDataFrame([
        fx("0000000001", 1, 1, "2P", "2P", 2, 2),                       # with a contract line -> soft FMC, P3
        fx("0000000002", 1, 1, "1P", "1P", 1, 1),                       # fixed only -> Fixed 1P, P1_Fixed
        fx("0000000003", 1, 0, "3P", None, 3, None, L.FIXED_VOL),       # fixed churner, no mobile
        fx("0000000005", 1, 1, "1P", "1P", 1, 1),                       # e-mail match only -> near FMC
    ], FIXED)
    mobile = spark.createDataFrame([
        mb("L1", 1, 1, "1"),                                            # contract 1 (padded to match)
        mb("L4", 1, 1, None),                                           # mobile only
        mb("L5", 0, 1, None, email="x@y"),                              # new line, no contract
    ], MOBILE)
    t = {(r.fixed_account, r.mobile_account): r for r in V.fmc_table(fixed, mobile).collect()}
    soft = t[("0000000001", "L1")]
    assert (soft.b_fmc_status, soft.b_fmc_type, soft.b_fmc_segment) == (L.FMC_SOFT, L.FMC_SOFT, "P3")
    assert soft.final_account == "0000000001L1" and soft.contracts_fix == 1
    fo = t[("0000000002", None)]
    assert (fo.b_fmc_status, fo.b_fmc_type, fo.b_fmc_segment, fo.final_churn_flag) == \
        (L.FMC_FIXED_ONLY, "Fixed 1P", L.SEG_P1_FIXED, L.CHURN_NONE)
    ch = t[("0000000003", None)]
    assert ch.final_churn_flag == L.CHURN_FULL and ch.waterfall_flag == L.CHURN_FULL
    assert ch.partial_total_churn_flag == "Total Churner" and ch.churn_type_final_flag == "Voluntary"
    mo = t[(None, "L4")]
    assert (mo.b_fmc_status, mo.b_fmc_type, mo.b_fmc_segment, mo.final_account) == \
        (L.FMC_MOBILE_ONLY, L.FMC_MOBILE_ONLY, L.SEG_P1_MOBILE, "L4")
    new_line = t[(None, "L5")]
    assert new_line.final_bom_active_flag == 0 and new_line.b_fmc_status is None


def test_fan_out_divides_fixed_values(spark):
    fixed = spark.createDataFrame([fx("0000000007", 1, 1, "2P", "2P", 2, 2)], FIXED)
    mobile = spark.createDataFrame([mb("A", 1, 1, "7"), mb("B", 1, 1, "7")], MOBILE)
    rows = V.fmc_table(fixed, mobile).collect()
    assert {r.contracts_fix for r in rows} == {2}
    # each row carries half of the fixed products plus its own line
    assert {r.b_total_rgus for r in rows} == {(2 + 1) / 2}


def emails(spark):
    snap = spark.createDataFrame([("1", M, "a@x"), ("2", M, "a@x"), ("1", dt.date(2022, 2, 1), "a@x"), ("3", M, "NA@GMAIL.COM"),
                                  ("4", M, None), ("5", M, "b@x")], "act_acct_cd string, dt date, act_contact_mail_1 string")
    reg = spark.createDataFrame([("8.1", M, "a@x", "Residencial"), ("8.1", M, "a@x", "Residencial"), ("8.2", M, "NA@GMAIL.COM", "Residencial"),
                                 ("8.3", dt.date(2022, 2, 1), "a@x", "Residencial"), ("", M, "a@x", "Residencial"),
                                 ("8.4", M, "b@x", "Empresas - Pymes")],
                                "id_abonado string, fecha_parque date, nom_email string, des_segmento_cliente string")
    return snap, reg


def test_email_match_keeps_every_account_of_an_address(spark):
    snap, reg = emails(spark)
    plain = {(r.near_line, r.near_file, r.contr) for r in V.email_match(reg, V.fixed_emails(snap)).collect()}
    feb = dt.date(2022, 2, 1)
    assert plain == {("81", M, "1"), ("81", M, "2"), ("83", feb, "1"), ("83", feb, "2")}
    salted = V.email_match(reg, V.fixed_emails(snap), salt=4).collect()
    assert len(salted) == len(plain) and {(r.near_line, r.near_file, r.contr) for r in salted} == plain
    dated = {(r.near_line, r.near_file, r.contr) for r in V.email_match(reg, V.fixed_emails(snap, day="dt")).collect()}
    assert dated == {("81", M, "1"), ("81", M, "2"), ("83", feb, "1")}


def test_contract_resolution_order_and_fan_out(spark):
    schema = ("mobile_month date, mobile_account string, b_fixed_contract string, e_fixed_contract string, b_contr string, "
              "e_contr string, b_email string, e_email string, mobile_active_bom int, mobile_active_eom int, "
              "mobile_churn_type string, b_mobile_mrc double, e_mobile_mrc double")
    rows = [(M, "L1", "7", "8", "9", "9", "a", "a", 1, 1, None, 10.0, 10.0), (M, "L2", None, "8", "7", None, "a", None, 1, 1, None, 10.4, 10.0),
            (M, "L3", None, "8", None, "9", None, "a", 1, 1, None, 10.0, 10.0), (M, "L4", None, None, None, "8", None, "a", 0, 1, None, 1.0, 1.0),
            (M, "L5", None, None, None, None, None, None, 1, 1, None, 1.0, 1.0)]
    resolved = V.resolve_contract(spark.createDataFrame(rows, schema))
    got = {r.mobile_account: (r.b_contract_adj, r.e_contract_adj, r.contract_adj, r.fixed_count) for r in resolved.collect()}
    assert got == {"L1": ("7", "8", "7", 2), "L2": ("7", "8", "7", 2), "L3": (None, "8", "8", 2), "L4": (None, "8", "8", 2),
                   "L5": (None, None, None, None)}
    fixed = spark.createDataFrame([fx("7", 1, 1, "2P", "2P", 2, 2), fx("6", 1, 0, "1P", "1P", 1, 1)], FIXED)
    base = {(r.final_account, r.mobile_account): r for r in V.fmc_base_resolved(fixed, resolved).collect()}
    assert {k: (r.contracts_fix, r.b_fmc_status, r.e_fmc_status, r.b_total_mrc) for k, r in base.items()} == {
        ("7", "L1"): (2, L.FMC_SOFT, L.FMC_SOFT, 35.0), ("7", "L2"): (2, L.FMC_NEAR, L.FMC_SOFT, 35.0),
        ("L3", "L3"): (2, L.FMC_MOBILE_ONLY, L.FMC_MOBILE_ONLY, 10.0), ("L4", "L4"): (2, None, L.FMC_NEAR, 1.0),
        ("L5", "L5"): (1, L.FMC_MOBILE_ONLY, L.FMC_MOBILE_ONLY, 1.0), ("6", None): (1, L.FMC_FIXED_ONLY, None, 50.0)}


def test_charges_are_whole_before_they_are_shared(spark):
    fixed = spark.createDataFrame([fx("0000000007", 1, 1, "2P", "2P", 2, 2)], FIXED).withColumn("b_bill_amt", F.lit(50.6))
    mobile = spark.createDataFrame([mb("A", 1, 1, "7")], MOBILE).withColumn("b_mobile_mrc", F.lit(10.4))
    assert V.fmc_table(fixed, mobile).first().b_total_mrc == 61.0
