"""Fixed-mobile convergence.

The convergence table is a full outer join of the fixed table (one row per
account and period) with the mobile table (one row per line and period) on
the padded contract key and the period. A fixed account with several lines
gets one row per line (``contracts_fix`` counts them, fixed values are
divided by it). Every label is an ordered rule list evaluated on that row.

Rules follow the intent of the Presto scripts: tests against the label
``'1. Mobile Churner'``, which no step produces, are written as tests on
``mobile_churn_type`` being set; ``parity=True`` keeps the literal tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import labels as L
from churnlens.functions.cache import col, lit, memo
from churnlens.functions.keys import DUMMY_EMAILS, pad_key, strip_dots
from churnlens.functions.rules import case_when
from churnlens.params import Params


def _is1(c: str) -> Column:
    """Null-safe ``c = 1`` (a missing side counts as not active)."""
    return memo(("is1", c), lambda: F.coalesce(col(c), lit(0)) == 1)


def _not1(c: str) -> Column:
    return memo(("not1", c), lambda: F.coalesce(col(c), lit(0)) == 0)


def _in(c: str, *vals) -> Column:
    return memo(("in", c, vals), lambda: col(c).isin(list(vals)))


def fixed_emails(snap: DataFrame, email: str = "act_contact_mail_1", key: str = "act_acct_cd",
                 dummies=DUMMY_EMAILS, day: str | None = None) -> DataFrame:
    """Distinct (e-mail, account) of the fixed snapshots without dummy
    addresses; with ``day`` also the snapshot day (D60)."""
    keep = [col(email).alias("email"), col(key).alias("contr")] + ([col(day).cast("date").alias("email_day")] if day else [])
    return snap.where(col(email).isNotNull() & ~col(email).isin(list(dummies))).select(*keep).distinct()


def email_match(register: DataFrame, fixed: DataFrame, dummies=DUMMY_EMAILS,
                business=L.BUSINESS_SEGMENTS, salt: int = 1) -> DataFrame:
    """Near-FMC candidates: every fixed account whose e-mail is a register
    line's, one row per (line, register file, account) (D60).

    When ``fixed`` carries ``email_day`` (the dated form) the register file
    must be of that day. An address many accounts share multiplies rows on
    purpose: each account keeps its match. Both sides are distinct before they
    meet; ``salt`` deals the accounts of an address over so many tasks (the
    register side is repeated per salt) where adaptive skew handling is off.
    """
    r = (register.where(~col("des_segmento_cliente").isin(list(business)) & ~col("nom_email").isin(list(dummies)))
                 .select(strip_dots("id_abonado").alias("near_line"), col("fecha_parque").cast("date").alias("near_file"),
                         col("nom_email").alias("email")))
    r = r.where(col("near_line") != "").distinct()
    keys = ["email"]
    if "email_day" in fixed.columns:
        fixed = fixed.withColumnRenamed("email_day", "near_file")
        keys.append("near_file")
    if salt > 1:
        fixed = fixed.withColumn("_salt", F.pmod(F.xxhash64("contr"), F.lit(salt)))
        r = r.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salt)])))
        keys.append("_salt")
    return r.join(fixed, keys, "inner").select("near_line", "near_file", "email", "contr")


def attach_near(mobile: DataFrame, near: DataFrame, params: Params = Params()) -> DataFrame:
    """E-mail match of the opening file (same period) and of the closing file
    (next period) for each mobile row (D60, D61)."""
    g = params.grain
    b = near.select(col("near_line").alias("_bl"), col("near_file").alias("_bf"),
                    col("email").alias("b_email"), col("contr").alias("b_contr"))
    e = near.select(col("near_line").alias("_el"), g.shift(col("near_file"), -1).alias("_ef"),
                    col("email").alias("e_email"), col("contr").alias("e_contr"))
    m = mobile.join(b, (col("mobile_account") == col("_bl")) & (col("mobile_month") == col("_bf")), "left")
    m = m.join(e, (col("mobile_account") == col("_el")) & (col("mobile_month") == col("_ef")), "left")
    return m.drop("_bl", "_bf", "_el", "_ef")


def resolve_contract(mobile: DataFrame) -> DataFrame:
    """Contract of each mobile row from dated sources in order: the opening
    file, the opening e-mail match, the closing file, the closing e-mail match
    (D61); ``fixed_count`` counts the rows that then share it in a period (D65).

    ``mobile`` comes from ``attach_near``, so a line whose address several
    accounts share has a row per account; the count is a partial aggregate
    joined back from the left, so a hot contract's rows can be split."""
    m = mobile.withColumns({
        "b_contract_adj": F.coalesce("b_fixed_contract", "b_contr"),
        "e_contract_adj": F.coalesce("e_fixed_contract", "e_contr"),
    }).withColumn("contract_adj", F.coalesce("b_contract_adj", "e_contract_adj"))
    count = m.where(col("contract_adj").isNotNull()).groupBy(
        col("contract_adj").alias("_cc"), col("mobile_month").alias("_cm")).agg(F.count(F.lit(1)).alias("fixed_count"))
    return m.join(count, (col("contract_adj") == col("_cc")) & (col("mobile_month") == col("_cm")), "left").drop("_cc", "_cm")


def fmc_base_resolved(fixed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fixed-mobile rows by the resolved contract (D64-D67, BigQuery form):
    the final account is the fixed one where there is one, the fan-out is
    ``fixed_count``, and charges are rounded after the division (D66).

    Rows that differ only in the e-mail match are one row, as there; the full
    join is a left join plus fixed rows whose (account, period) no line has."""
    m = resolved.withColumn("mobile_month", col("mobile_month").cast("date"))
    matched = m.join(fixed, (col("fixed_account") == col("contract_adj")) & (col("fixed_month") == col("mobile_month")), "left")
    met = m.where(col("contract_adj").isNotNull()).select(
        col("contract_adj").alias("_mc"), col("mobile_month").alias("_mm")).distinct()
    only_fixed = fixed.join(met, (col("fixed_account") == col("_mc")) & (col("fixed_month") == col("_mm")), "left_anti")
    j = matched.unionByName(only_fixed, allowMissingColumns=True)
    fa, ma = col("fixed_account").isNotNull(), col("mobile_account").isNotNull()
    n = F.coalesce(col("fixed_count"), F.lit(1).cast("long"))

    def status(active, mobile_active, email, contract, near_needs_active, lost):
        near = col(email).isNotNull() & col(contract).isNull()
        return case_when([
            (fa & ma & _is1(active) & _is1(mobile_active) & col(contract).isNotNull(), L.FMC_SOFT),
            ((near & _is1(active) if near_needs_active else near) | (_is1(active) & _is1(mobile_active)), L.FMC_NEAR),
            (fa & _is1(active) & _not1(mobile_active), L.FMC_FIXED_ONLY),
            (ma & _is1(mobile_active) & _not1(active) & lost, L.FMC_MOBILE_ONLY),
        ])

    def total(fixed_charge, mobile_charge):
        share = F.round(F.coalesce(col(fixed_charge) / n, F.lit(0.0)), 0)
        return F.round(share + F.coalesce(col(mobile_charge), F.lit(0.0)), 0)

    out = j.withColumns({
        "month": F.when(fa, col("fixed_month")).otherwise(col("mobile_month")),
        "final_account": F.coalesce("fixed_account", "mobile_account"),
        "final_bom_active_flag": (_is1("active_bom") | _is1("mobile_active_bom")).cast("int"),
        "final_eom_active_flag": (_is1("active_eom") | _is1("mobile_active_eom")).cast("int"),
        "contracts_fix": n,
        "b_fmc_status": status("active_bom", "mobile_active_bom", "b_email", "b_fixed_contract", True, F.lit(True)),
        "e_fmc_status": status("active_eom", "mobile_active_eom", "e_email", "e_fixed_contract", False,
                               col("mobile_churn_type").isNull()),
        "b_total_mrc": total("b_bill_amt", "b_mobile_mrc"), "e_total_mrc": total("e_bill_amt", "e_mobile_mrc"),
    })
    return out.drop("b_email", "e_email", "b_contr", "e_contr", "b_contract_adj", "e_contract_adj", "contract_adj",
                    "fixed_count").distinct()


def fmc_base(fixed: DataFrame, mobile: DataFrame, width: int = 10) -> DataFrame:
    """Full outer join on the padded contract and the period, with month,
    combined account, active flags and the fixed fan-out (D64, D65).

    The fixed side has one row per (account, period) and plan, few rows; on
    the mobile side a contract may hold many lines, and a hot contract could
    hold a large share of them. AQE cannot split skewed partitions of a full outer join, so it
    is built from joins it can split: the mobile lines are counted per
    (contract, period) (a partial aggregate), the fixed rows take that count
    one-to-one, every mobile line then left-joins its fixed rows (a hot
    contract's lines can be split, the fixed rows are replicated), and fixed
    rows without a count are added as fixed-only rows. The count, times the
    account's plan rows, is the fan-out ``contracts_fix``."""
    f = fixed.withColumn("_fk", pad_key("fixed_account", width))
    m = mobile.withColumn("_mk", pad_key("fmc_account", width))
    lines = m.groupBy(col("_mk").alias("_ck"), col("mobile_month").alias("_cm")).agg(F.count(F.lit(1)).alias("_n"))
    f = f.join(lines, (col("_fk") == col("_ck")) & (col("fixed_month") == col("_cm")), "left").drop("_ck", "_cm")
    f = f.withColumn("_plans", F.count(F.lit(1)).over(Window.partitionBy("_fk", "fixed_month", "fixed_account")))
    matched = m.join(f, (col("_fk") == col("_mk")) & (col("fixed_month") == col("mobile_month")), "left")
    only_fixed = f.where(col("_n").isNull())
    j = matched.unionByName(only_fixed, allowMissingColumns=True)
    fa, ma = col("fixed_account").isNotNull(), col("mobile_account").isNotNull()
    return j.drop("_fk", "_mk").withColumns({
        "month": F.when(fa, col("fixed_month")).otherwise(col("mobile_month")),
        "final_account": case_when([(fa & ~ma, col("fixed_account")), (~fa & ma, col("mobile_account")),
                                    (fa & ma, F.concat("fixed_account", "mobile_account"))]),
        "final_bom_active_flag": (_is1("active_bom") | _is1("mobile_active_bom")).cast("int"),
        "final_eom_active_flag": (_is1("active_eom") | _is1("mobile_active_eom")).cast("int"),
        "contracts_fix": F.when(fa, F.coalesce(col("_n"), F.lit(1).cast("long")) * col("_plans")).otherwise(
            F.lit(1).cast("long")),
    }).drop("_n", "_plans")


def fmc_status(df: DataFrame, parity: bool = False) -> DataFrame:
    """Soft / near FMC, fixed only, mobile only at opening and closing."""
    fa, ma = col("fixed_account").isNotNull(), col("mobile_account").isNotNull()
    not_churned = (col("mobile_churn_type").isNull() | (col("mobile_churn_type") != "1. Mobile Churner")) \
        if parity else col("mobile_churn_type").isNull()
    out = {}
    for s, a, ma_flag, extra in (("b", "active_bom", "mobile_active_bom", F.lit(True)),
                                 ("e", "active_eom", "mobile_active_eom", not_churned)):
        out[f"{s}_fmc_status"] = case_when([
            (fa & ma & _is1(a) & _is1(ma_flag) & col(f"{s}_fixed_contract").isNotNull(), L.FMC_SOFT),
            ((col(f"{s}_email").isNotNull() & col(f"{s}_fixed_contract").isNull() & _is1(a))
             | (_is1(a) & _is1(ma_flag)), L.FMC_NEAR),
            (fa & _is1(a) & _not1(ma_flag), L.FMC_FIXED_ONLY),
            (ma & _is1(ma_flag) & _not1(a) & extra, L.FMC_MOBILE_ONLY),
        ])
    return df.withColumns(out)


def fmc_type(df: DataFrame, parity: bool = False) -> DataFrame:
    """Fixed nP / mobile only / soft or near FMC / fixed 0P."""
    bs, es = "b_fmc_status", "e_fmc_status"
    fct, mct = col("fixed_churner_type"), col("mobile_churn_type")
    mob_churned = (mct == "1. Mobile Churner") if parity else mct.isNotNull()
    mob_alive = (mct != "1. Mobile Churner") if parity else mct.isNull()
    b_rules = [(_in(bs, L.FMC_FIXED_ONLY, L.FMC_SOFT, L.FMC_NEAR) & _not1("mobile_active_bom")
                & (col("b_mix") == mix), lab) for mix, lab in L.FMC_TYPE_FIXED.items()]
    b_rules += [
        (_in(bs, L.FMC_SOFT, L.FMC_NEAR) & _not1("active_bom"), L.FMC_MOBILE_ONLY),
        (col(bs) == L.FMC_MOBILE_ONLY, col(bs)),
        (_in(bs, L.FMC_NEAR, L.FMC_SOFT), col(bs)),
        (_is1("final_bom_active_flag") & (col("b_num_rgus") == 0), L.FMC_TYPE_FIXED_0P),
    ]
    e_fixed_ok = _not1("mobile_active_eom") | (_is1("mobile_active_eom") & mct.isNotNull())
    e_rules = [
        ((col(es) == L.FMC_FIXED_ONLY) & fct.isNotNull(), F.lit(None).cast("string")),
        ((col(es) == L.FMC_MOBILE_ONLY) & mob_churned, F.lit(None).cast("string")),
    ]
    e_rules += [((col(es) == L.FMC_FIXED_ONLY) & e_fixed_ok & (col("e_mix") == mix), lab)
                for mix, lab in L.FMC_TYPE_FIXED.items()]
    e_rules += [
        ((_in(es, L.FMC_SOFT, L.FMC_NEAR, L.FMC_MOBILE_ONLY) & (_not1("active_eom") | (_is1("active_eom") & fct.isNotNull())))
         | ((col(es) == L.FMC_MOBILE_ONLY) | (_not1("active_eom") & _is1("mobile_active_eom"))), L.FMC_MOBILE_ONLY),
        (_in(es, L.FMC_SOFT, L.FMC_NEAR) & fct.isNull() & mob_alive & _is1("active_eom") & _is1("mobile_active_eom"),
         col(es)),
        (_is1("final_eom_active_flag") & (col("e_num_rgus") == 0), L.FMC_TYPE_FIXED_0P),
    ]
    return df.withColumns({"b_fmc_type": case_when(b_rules), "e_fmc_type": case_when(e_rules),
                           "b_mobile_rgus": _is1("mobile_active_bom").cast("int"),
                           "e_mobile_rgus": _is1("mobile_active_eom").cast("int")})


def final_tech_and_tenure(df: DataFrame) -> DataFrame:
    """Wireless or the fixed technology; tenure from fixed, else mobile."""
    fct, mct = col("fixed_churner_type"), col("mobile_churn_type")
    soft_near = (L.FMC_SOFT, L.FMC_NEAR)
    return df.withColumns({
        "b_final_tech_flag": case_when([
            ((col("b_fmc_status") == L.FMC_FIXED_ONLY)
             | (_in("b_fmc_status", *soft_near) & _is1("active_bom") & _is1("mobile_active_bom")), col("b_tech_flag")),
            ((col("b_fmc_status") == L.FMC_MOBILE_ONLY)
             | (_in("b_fmc_status", *soft_near, "Undefined FMC") & _not1("active_bom")), L.WIRELESS),
        ]),
        "e_final_tech_flag": case_when([
            (((col("e_fmc_status") == L.FMC_FIXED_ONLY) & fct.isNull())
             | (_in("e_fmc_status", *soft_near) & _is1("active_eom") & _is1("mobile_active_eom") & fct.isNull()),
             col("e_tech_flag")),
            ((col("e_fmc_status") == L.FMC_MOBILE_ONLY)
             | (_in("e_fmc_status", *soft_near) & _not1("active_eom")), L.WIRELESS),
        ]),
        "b_tenure_final_flag": F.coalesce("b_fixed_tenure_segment", "b_mobile_tenure_segment"),
        "e_tenure_final_flag": case_when([
            (col("e_fixed_tenure_segment").isNotNull() & fct.isNull(), col("e_fixed_tenure_segment")),
            (col("e_mobile_tenure_segment").isNotNull() & mct.isNull(), col("e_mobile_tenure_segment")),
        ]),
    })


def fmc_segment(df: DataFrame) -> DataFrame:
    """P1_Fixed, P1_Mobile, P2, P3, P4, P0, P0_Fixed."""
    fct, mct = col("fixed_churner_type"), col("mobile_churn_type")
    sn = (L.FMC_SOFT, L.FMC_NEAR)
    fixed_types = tuple(L.FMC_TYPE_FIXED.values())
    b = [(_in("b_fmc_type", *sn) & (col("b_mix") == mix), seg) for mix, seg in L.SEG_BY_MIX.items()]
    b += [
        (_in("b_fmc_type", *fixed_types) | (_in("b_fmc_type", *sn) & _not1("mobile_active_bom") & _is1("active_bom")),
         L.SEG_P1_FIXED),
        ((col("b_fmc_type") == L.FMC_MOBILE_ONLY)
         | ((col("b_fmc_type") == L.FMC_SOFT) & _not1("active_bom") & _is1("mobile_active_bom")), L.SEG_P1_MOBILE),
        ((col("b_fmc_type") == L.FMC_TYPE_FIXED_0P)
         | (_in("b_fmc_type", *sn) & _not1("mobile_active_bom") & _is1("active_bom")), L.SEG_P0_FIXED),
    ]
    both = _is1("active_eom") & _is1("mobile_active_eom") & fct.isNull() & mct.isNull()
    e = [(_in("e_fmc_type", *sn, "Undefined FMC") & both & (col("e_mix") == mix), L.SEG_BY_MIX[mix])
         for mix in ("1P", "2P", "3P")]
    e += [
        ((_in("e_fmc_type", *fixed_types) | (_in("e_fmc_type", *sn) & _not1("mobile_active_eom")))
         & _is1("active_eom") & fct.isNull(), L.SEG_P1_FIXED),
        (((col("e_fmc_type") == L.FMC_MOBILE_ONLY) | ((col("e_fmc_type") == L.FMC_SOFT) & _not1("active_eom")))
         & _is1("mobile_active_eom") & mct.isNull(), L.SEG_P1_MOBILE),
        ((col("e_fmc_type") == L.FMC_TYPE_FIXED_0P)
         | (_in("e_fmc_type", *sn) & _not1("mobile_active_eom") & _is1("active_eom")), L.SEG_P0_FIXED),
        (_in("e_fmc_type", *sn) & (col("e_mix") == "0P"), L.SEG_BY_MIX["0P"]),
    ]
    return df.withColumns({"b_fmc_segment": case_when(b), "e_fmc_segment": case_when(e)})


def whole(c: str) -> Column:
    """A charge in whole units, 0 when absent: the Presto form casts charges to integers before it adds them."""
    return F.coalesce(F.round(col(c), 0), F.lit(0.0))


def final_churn(df: DataFrame) -> DataFrame:
    """Full / fixed / mobile / previous / non churner (D71) and totals."""
    fct, mct = col("fixed_churner_type"), col("mobile_churn_type")
    n = col("contracts_fix")
    return df.withColumns({
        "final_churn_flag": case_when([
            ((fct.isNotNull() & mct.isNotNull()) | ((col("b_fmc_status") == L.FMC_FIXED_ONLY) & fct.isNotNull())
             | ((col("b_fmc_status") == L.FMC_MOBILE_ONLY) & mct.isNotNull())
             | (fct.isNull() & _is1("active_bom") & _is1("mobile_active_bom") & _not1("active_eom")
                & _not1("mobile_active_eom")), L.CHURN_FULL),
            (fct.isNotNull() & mct.isNull(), L.CHURN_FIXED),
            (fct.isNull() & mct.isNotNull(), L.CHURN_MOBILE),
            ((fct.isNotNull() & _not1("active_bom")) | (mct.isNotNull() & _not1("mobile_active_bom")), L.CHURN_PREVIOUS),
        ], L.CHURN_NONE),
        "b_total_mrc": whole("b_bill_amt") / n + whole("b_mobile_mrc"),
        "e_total_mrc": whole("e_bill_amt") / n + whole("e_mobile_mrc"),
        "b_total_rgus": (F.coalesce(col("b_num_rgus"), F.lit(0)) + col("b_mobile_rgus")) / n,
        "e_total_rgus": (F.coalesce(col("e_num_rgus"), F.lit(0)) + col("e_mobile_rgus")) / n,
        "total_rgu_churn": F.coalesce(col("fixed_rgu_churn"), F.lit(0)) / n
                           + F.coalesce(col("mobile_rgu_churn"), F.lit(0)),
    }).withColumn("mrc_change", F.round("e_total_mrc", 0) - F.round("b_total_mrc", 0))


def final_rejoiner(df: DataFrame) -> DataFrame:
    """Fixed, mobile or FMC rejoiner."""
    fr, mr = col("fixed_rejoiner_type"), col("mobile_rejoiner_type")
    return df.withColumn("rejoiner_final_flag", case_when([
        ((fr.isNotNull() & mr.isNotNull()) | ((fr.isNotNull() | mr.isNotNull()) & _in("e_fmc_type", L.FMC_SOFT, L.FMC_NEAR)),
         L.REJ_FMC),
        (fr.isNotNull(), L.REJ_FIXED),
        (mr.isNotNull(), L.REJ_MOBILE),
    ]))


def waterfall(df: DataFrame) -> DataFrame:
    """Total/partial churn, churn type and one movement label per row from
    opening to closing (D71 tail, D73, Presto order: churn label first)."""
    fcf = col("final_churn_flag")
    fct, mct = col("fixed_churner_type"), col("mobile_churn_type")
    fr, mr = col("fixed_rejoiner_type"), col("mobile_rejoiner_type")
    br, er = col("b_total_rgus"), col("e_total_rgus")
    bm, em = col("b_total_mrc"), col("e_total_mrc")
    sn = (L.FMC_SOFT, L.FMC_NEAR)
    mm_gain = _in("main_movement", L.MM_COMEBACK, L.MM_NEW)
    mob_gain = _in("mobile_movement_flag", L.MOB_COMEBACK, L.MOB_NEW)
    return df.withColumns({
        "partial_total_churn_flag": case_when([
            (fcf == L.CHURN_FULL, "Total Churner"),
            (_in("final_churn_flag", L.CHURN_FIXED, L.CHURN_MOBILE), "Partial Churner"),
            (fcf == L.CHURN_PREVIOUS, L.CHURN_PREVIOUS),
        ]),
        "churn_type_final_flag": case_when([
            (fct == L.FIXED_VOL, "Voluntary"), (mct == L.MOBILE_VOL, "Voluntary"),
            (fct == L.FIXED_INVOL, "Involuntary"), (mct == L.MOBILE_INVOL, "Involuntary"),
            (col("main_movement") == L.MM_DOWNSELL, "Voluntary"),
        ]),
        "waterfall_flag": case_when([
            (fcf != L.CHURN_NONE, fcf),
            ((br == er) & (bm == em), "Maintain"),
            (br < er, "Upsell"),
            (br > er, "Downsell"),
            ((br == er) & (bm < em), "Upspin"),
            ((br == er) & (bm > em), "Downspin"),
            (_in("b_fmc_type", *L.FMC_TYPE_FIXED.values(), L.FMC_TYPE_FIXED_0P, L.FMC_MOBILE_ONLY)
             & _in("e_fmc_type", *sn), "FMC Packing"),
            ((col("final_bom_active_flag") == 0) & _in("e_fmc_type", *sn), "FMC Gross Add"),
            (fr.isNotNull() & mr.isNotNull(), L.REJ_FMC),
            (fr.isNotNull(), L.REJ_FIXED),
            (mr.isNotNull(), L.REJ_MOBILE),
            (mm_gain & mob_gain, "FMC Gross Add"),
            (mm_gain, "Fixed Gross Add"),
            (mob_gain, "Mobile Gross Add"),
        ]),
        "b_plan_full": F.concat(F.coalesce(col("b_plan"), F.lit("")),
                                F.coalesce(col("mobile_active_bom").cast("string"), F.lit("-"))),
        "e_plan_full": F.concat(F.coalesce(col("e_plan"), F.lit("")),
                                F.coalesce(col("mobile_active_eom").cast("string"), F.lit("-"))),
    })


def movement_split(df: DataFrame) -> DataFrame:
    """Voluntary / churn type / undefined split of downsells, voluntary
    downspins (D74)."""
    wf = col("waterfall_flag")
    return df.withColumns({
        "downsell_split": case_when([
            ((wf == "Downsell") & (col("main_movement") == L.MM_DOWNSELL), "Voluntary"),
            ((wf == "Downsell") & (col("final_churn_flag") != L.CHURN_NONE), col("churn_type_final_flag")),
            ((wf == "Downsell") & (col("main_movement") == L.MM_LOSS), "Undefined"),
        ]),
        "downspin_split": F.when(wf == "Downspin", F.lit("Voluntary")),
    })


def fmc_table(fixed: DataFrame, mobile_with_near: DataFrame, parity: bool = False) -> DataFrame:
    t = fmc_base(fixed, mobile_with_near)
    t = fmc_status(t, parity)
    t = fmc_type(t, parity)
    t = final_tech_and_tenure(t)
    t = fmc_segment(t)
    t = final_churn(t)
    t = final_rejoiner(t)
    t = waterfall(t)
    return movement_split(t)


def fmc_grouped(df: DataFrame, dims) -> DataFrame:
    """Distinct combined, fixed and mobile accounts and sums of the rounded
    charges over the report dimensions (D76)."""
    return (df.groupBy(*dims).agg(F.count_distinct("final_account").alias("accounts"),
                                  F.count_distinct("fixed_account").alias("fixed_accounts"),
                                  F.count_distinct("mobile_account").alias("mobile_accounts"),
                                  F.sum(F.round("b_total_mrc", 0)).cast("long").alias("b_mrc"),
                                  F.sum(F.round("e_total_mrc", 0)).cast("long").alias("e_mrc"),
                                  F.round(F.sum("total_rgu_churn"), 4).alias("rgu_churn")))


def fmc_packing(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Accounts convergent at closing but not at opening (packing) and the
    reverse (unpacking), counted per period (D77). One aggregate per
    (period, account) marks convergence at each end; a second one counts
    the accounts whose marks differ - no distinct sets, no anti-joins."""
    sn = (L.FMC_SOFT, L.FMC_NEAR)
    key = F.coalesce(col("fixed_account"), col("fmc_account"))
    per = df.groupBy(col("month"), key.alias("acct")).agg(
        F.max(_in("b_fmc_type", *sn).cast("int")).alias("_b"), F.max(_in("e_fmc_type", *sn).cast("int")).alias("_e"))
    b, e = F.coalesce(col("_b"), F.lit(0)), F.coalesce(col("_e"), F.lit(0))
    return per.groupBy("month").agg(F.sum(((e == 1) & (b == 0)).cast("int")).cast("long").alias("packing"),
                                    F.sum(((b == 1) & (e == 0)).cast("int")).cast("long").alias("unpacking"))


def phone_match(fixed: DataFrame, mobile: DataFrame, phone_cols=("act_contact_phone_1", "act_contact_phone_2",
                                                                  "act_contact_phone_3"),
                key: str = "act_acct_cd", mobile_phone: str = "num_telefono", by=()) -> DataFrame:
    """Best of several contact phones that exists in the mobile base.

    The phones are unpivoted with their priority (``stack``), joined once to
    the distinct mobile phones and reduced per account with ``min_by`` on the
    priority: one join instead of a union of one join per phone column. An
    account without a match keeps its first phone, with a null priority.
    ``by`` names columns both sides must agree on (period, opening and closing
    day)."""
    by = list(by)
    cols = [c for c in phone_cols if c in fixed.columns]
    pairs = ", ".join(f"{i}, {c}" for i, c in enumerate(cols, 1))
    long = fixed.selectExpr(key, *by, f"stack({len(cols)}, {pairs}) AS (priority, phone)").where(col("phone").isNotNull())
    mob = mobile.select(col(mobile_phone).alias("phone"), *by).where(col("phone").isNotNull()).distinct()
    best = (long.join(mob, ["phone", *by], "inner").groupBy(key, *by)
                .agg(F.min_by("phone", "priority").alias("_matched"), F.min("priority").alias("phone_priority")))
    every = fixed.select(key, *by, col(cols[0]).alias("_own")).distinct()
    return every.join(best, [key, *by], "left").select(
        key, *by, F.coalesce("_matched", "_own").alias("matched_phone"), "phone_priority")


def household_match(fixed: DataFrame, mobile: DataFrame, fixed_base: DataFrame, mobile_base: DataFrame,
                    household: str = "household_id", day: str = "dt", key: str = "act_acct_cd",
                    line: str = "mobile_account", params: Params = Params()) -> DataFrame:
    """Real FMC (D62): fixed accounts and mobile lines that share a household
    on a day, each present in the base of its period.

    One row per member (``side`` 'fixed' or 'mobile') of a household-day that
    has both sides, with the household's representative pair (smallest account,
    smallest line) and the size of each side: an account and a line match
    exactly when they are members of one household-day, so no member and no
    link is lost and the rows stay linear however large a household is.
    ``fixed_base`` (fixed_account, fixed_month) and ``mobile_base``
    (mobile_account, mobile_month) decide presence."""
    g = params.grain

    def members(df, member, base, account, month):
        m = df.where(col(household).isNotNull()).select(
            col(household).alias("household_id"), col(day).cast("date").alias("dt"), col(member).alias("member")).distinct()
        present = base.select(col(account).alias("_pa"), col(month).alias("_pm")).distinct()
        return m.join(present, (col("member") == col("_pa")) & (g.trunc(col("dt")) == col("_pm")), "left_semi")

    f = members(fixed, key, fixed_base, "fixed_account", "fixed_month")
    m = members(mobile, line, mobile_base, "mobile_account", "mobile_month")
    both = f.withColumn("side", F.lit("fixed")).unionByName(m.withColumn("side", F.lit("mobile")))
    is_fixed = col("side") == "fixed"
    pair = both.groupBy("household_id", "dt").agg(
        F.min(F.when(is_fixed, col("member"))).alias("fmc_fixed"), F.min(F.when(~is_fixed, col("member"))).alias("fmc_mobile"),
        F.count(F.when(is_fixed, 1)).alias("n_fixed"), F.count(F.when(~is_fixed, 1)).alias("n_mobile"),
    ).where((col("n_fixed") > 0) & (col("n_mobile") > 0))
    return both.join(pair, ["household_id", "dt"], "inner").select(
        "household_id", "dt", "side", "member", "fmc_fixed", "fmc_mobile", "n_fixed", "n_mobile")


def fmc_list_periods(fmc_list: DataFrame, params: Params = Params(), business_unit: str | None = None,
                     account_type: str = "Residential") -> DataFrame:
    """Accounts an external FMC list marks convergent, per period (D75): a
    list file of period f marks period f + 1, and a later file (f + 1) adds
    the accounts whose FMC start lies in f (the ones the earlier file
    missed)."""
    g = params.grain
    ok = (col("account_type") == account_type) & col("service_type").isNotNull() \
        & (col("service_type") != "Service Not Found")
    if business_unit:
        ok = ok & (col("business_unit") == business_unit)
    lst = fmc_list.where(ok).select(col("account_no").alias("account"), col("dt").cast("date").alias("f"),
                                    F.try_to_date(col("fmc_start_date"), "MM/dd/yyyy").alias("s"))
    nxt = lst.select("account", g.shift(col("f"), 1).alias("month"))
    missed = lst.where(g.trunc(col("s")) == g.shift(col("f"), -1)).select("account", g.trunc(col("s")).alias("month"))
    return nxt.unionByName(missed).distinct()


def patch_fmc(df: DataFrame, listed: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Rewrite FMC types and segments from an external list.

    A row is listed, unlisted in a period the list covers, or of another
    period. Listed rows become convergent or mobile only; unlisted ones of a
    covered period lose a type that rests on no fixed product, unless the line
    is mobile at closing; other rows stay. ``periods`` (column ``month``) are
    the covered periods, by default those the list names; a row per period, so
    the join is with a few rows."""
    l = listed.select(col("account").alias("_la"), col("month").alias("_lm"), F.lit(1).alias("_listed"))
    covered = (listed if periods is None else periods).select(col("month").alias("_pm")).distinct().withColumn("_covered", F.lit(1))
    j = df.join(l, (col("final_account") == col("_la")) & (col("month") == col("_lm")), "left")
    j = j.join(covered, col("month") == col("_pm"), "left")
    on, unlisted = col("_listed").isNotNull(), col("_listed").isNull()
    in_list = col("_covered").isNotNull()
    no_b, no_e = col("b_mix").isNull(), col("e_mix").isNull()
    b_off, e_off = col("mobile_active_bom") != 1, col("mobile_active_eom") != 1
    none = F.lit(None).cast("string")

    def by_mix(mix):
        return [(on & (col(mix) == m), L.SEG_BY_MIX[m]) for m in ("1P", "2P", "3P")]

    return j.withColumns({
        "fmc_listed": F.coalesce(col("_listed"), F.lit(0)),
        "b_fmc_type_final": case_when([(on & no_b, L.FMC_MOBILE_ONLY), (on, "Soft/Hard FMC"), (no_b & in_list & b_off, none)],
                                      col("b_fmc_type")),
        "e_fmc_type_final": case_when([
            (unlisted & _is1("mobile_active_eom") & in_list & no_e, L.FMC_MOBILE_ONLY),
            (on & no_e & _is1("mobile_active_eom"), L.FMC_MOBILE_ONLY), (on & _is1("active_eom"), "Soft/Hard FMC"),
            (no_e & in_list & b_off, none)], col("e_fmc_type")),
        "b_fmc_segment_final": case_when([(on & no_b, L.SEG_P1_MOBILE), (no_b & in_list & b_off, none), *by_mix("b_mix")],
                                         col("b_fmc_segment")),
        "e_fmc_segment_final": case_when([(on & no_e & _is1("mobile_active_eom"), L.SEG_P1_MOBILE), (no_e & in_list & e_off, none),
                                          *by_mix("e_mix")], col("e_fmc_segment")),
    }).drop("_la", "_lm", "_listed", "_pm", "_covered")


GA_OR_REJOINER = "Fixed Gross Add or Mobile Gross Add/ Rejoiner"


def waterfall_bigquery(df: DataFrame) -> DataFrame:
    """Waterfall in the BigQuery order (T28): both periods active first,
    upsell/downsell only with an unchanged mobile state, then maintain,
    gross adds, spins, rejoiners, churn and gap labels. Movement codes are
    this library's (new customer = ``05. New Customer``; a mobile gross add
    or rejoiner = mobile new or come back)."""
    both = (col("final_bom_active_flag") == 1) & (col("final_eom_active_flag") == 1)
    gained = (col("final_bom_active_flag") == 0) & (col("final_eom_active_flag") == 1)
    lost = (col("final_bom_active_flag") == 1) & (col("final_eom_active_flag") == 0)
    mb, me = col("mobile_active_bom"), col("mobile_active_eom")
    same_mobile = (mb == me) | (mb.isNull() & me.isNull())
    b, e = col("b_num_rgus"), col("e_num_rgus")
    bm, em = col("b_total_mrc"), col("e_total_mrc")
    new_fixed = col("main_movement") == L.MM_NEW
    mob_ga = _in("mobile_movement_flag", L.MOB_NEW, L.MOB_COMEBACK)
    fcf = col("final_churn_flag")
    ab, ae = col("active_bom"), col("active_eom")
    mobile_both_or_none = ((mb == 1) & (me == 1)) | (mb.isNull() & me.isNull())
    rules = [
        (both & (b < e) & same_mobile, "Upsell"),
        (both & (b > e) & same_mobile, "Downsell"),
        (both & (b == e) & (bm == em), "Maintain"),
        (gained & ((new_fixed & mob_ga) | (new_fixed & col("mobile_movement_flag").isNull())
                   | (col("main_movement").isNull() & mob_ga)), GA_OR_REJOINER),
        (both & (b == e) & (bm > em), "Downspin"),
        (both & (b == e) & (bm < em), "Upspin"),
        (col("rejoiner_final_flag").isNotNull(), col("rejoiner_final_flag")),
        (both & ab.isNull() & ae.isNull() & (mb == 1) & (me == 1), "Maintain"),
        (both & (fcf == L.CHURN_FIXED) & mobile_both_or_none, L.CHURN_FIXED),
        (lost & (fcf == L.CHURN_FIXED) & mobile_both_or_none, L.CHURN_FIXED),
        (both & (ab == 0) & (ae == 1) & (mb == 1) & (me == 0), GA_OR_REJOINER),
        (both & (fcf == L.CHURN_FIXED) & (mb == 0) & (me == 1), "Fixed to Mobile Customer Gap"),
        (fcf == L.CHURN_FULL, L.CHURN_FULL),
        (fcf == L.CHURN_MOBILE, L.CHURN_MOBILE),
        (both & (ab == 1) & (ae == 0) & (fcf == L.CHURN_NONE), "Churn Gap"),
        (both & (mb == 0) & (me == 1) & (ab == 1) & (ae == 1), "Mobile Gross Adds"),
        (both & (ab == 1) & (ae == 1) & (mb == 1) & (me == 0), L.CHURN_MOBILE),
        (gained & (col("e_fmc_segment") == L.SEG_P1_FIXED) & col("rejoiner_final_flag").isNull(), GA_OR_REJOINER),
        (both & (ab == 0) & (ae == 1) & (mb == 1) & (me == 1), "FMC Packing"),
        ((col("b_fmc_status") == "Undefined FMC") | (col("e_fmc_status") == "Undefined FMC"), "Gap Undefined FMC"),
        (fcf == "Customer Gap", "Customer Gap"),
        (gained & (ab == 0) & (ae == 1) & (mb == 0) & (me == 1), "FMC Gross Add"),
        (gained & (ab == 0) & (ae == 1) & col("fixed_churner_type").isNotNull(), "Customer Gap"),
    ]
    return df.withColumn("waterfall_bq", case_when(rules))


def waterfall_jamaica(df: DataFrame) -> DataFrame:
    """Waterfall in the Jamaica order (T28): base exceptions first, then gross
    adds, rejoiners, RGU and MRC movements, churner types. The source's codes
    are read as this library's: new customer / come back to life are the
    ``05``/``04`` main movements and ``06.New Customer`` / ``05.Come Back To
    Life`` mobile movements, a missing main movement is the "null last day"
    code, a fixed churner is a set ``fixed_churner_type``."""
    both = (col("final_bom_active_flag") == 1) & (col("final_eom_active_flag") == 1)
    gained = (col("final_bom_active_flag") == 0) & (col("final_eom_active_flag") == 1)
    lost = (col("final_bom_active_flag") == 1) & (col("final_eom_active_flag") == 0)
    mm, mob, rej = col("main_movement"), col("mobile_movement_flag"), col("rejoiner_final_flag")
    fct = col("fixed_churner_type")
    br, er = col("b_total_rgus"), col("e_total_rgus")
    bm, em = col("b_total_mrc"), col("e_total_mrc")
    not_churner = col("final_churn_flag") != L.CHURN_NONE
    ctype = col("churn_type_final_flag")
    rules = [
        ((both | lost) & (F.coalesce(br, F.lit(0.0)) > F.coalesce(er, F.lit(0.0))) & mm.isNull()
         & (col("final_churn_flag") == L.CHURN_NONE), "Downsell-Fixed Customer Gap"),
        (((col("active_bom") == 1) & (col("active_eom") == 1) & (col("e_num_rgus") == 0) & fct.isNull())
         | ((col("active_bom") == 1) & (col("b_num_rgus") == 0)) | (fct.isNotNull() & _not1("active_bom")),
         "Fixed Base Exceptions"),
        (gained & (((mm == L.MM_NEW) & (mob == L.MOB_NEW)) | ((mm == L.MM_NEW) & mob.isNull())
                   | (mm.isNull() & (mob == L.MOB_NEW))), "Gross Ads"),
        (gained & ((mm == L.MM_COMEBACK) | (mob == L.MOB_COMEBACK)) & rej.isNull(), "Gross Ads"),
        (gained & ((rej.isin(L.REJ_FIXED, L.REJ_MOBILE) & _in("e_fmc_type", L.FMC_SOFT, L.FMC_NEAR))
                   | (rej == L.REJ_FMC)), L.REJ_FMC),
        (gained & (mm == L.MM_COMEBACK) & (rej == L.REJ_FIXED) & (col("e_fmc_segment") == L.SEG_P1_FIXED), L.REJ_FIXED),
        (gained & (mob == L.MOB_COMEBACK) & (rej == L.REJ_MOBILE) & (col("e_fmc_segment") == L.SEG_P1_MOBILE),
         L.REJ_MOBILE),
        (both & rej.isNotNull(), "Semi-rejoiner"),
        (both & (br < er), "Upsell"),
        (both & (br > er), "Downsell"),
        (both & (br == er) & (bm == em), "Maintain"),
        (both & (br == er) & (bm < em), "Upspin"),
        (both & (br == er) & (bm > em) & (em != 0), "Downspin"),
        (lost & not_churner & (ctype == "Voluntary"), "Voluntary Churners"),
        (lost & not_churner & (ctype == "Involuntary"), "Involuntary Churners"),
        (lost & not_churner & (ctype == "Anticipated Involuntary"), "Anticipated Involuntary Churners"),
        (lost & not_churner & (ctype == "Mixed"), "Mixed Churners"),
    ]
    return df.withColumn("waterfall_jm", case_when(rules))
