"""Registered queries: each runs one operator family over the whole test
tables of a scale-factor folder and returns a DataFrame whose columns match
the DuckDB statement of the same name in ``churnlens.plans.oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators import movement as M
from churnlens.operators import snapshot as S
from churnlens.params import Grain
from churnlens.plans import fixed as FX
from churnlens.sources import testdata as T
from churnlens.sources.io import population

P = T.TEST_PARAMS
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _snap(spark, sf):
    return T.fixed_snapshot(T.load(spark, sf, "events"))


def _fixed(spark, sf):
    return FX.fixed_stages(_snap(spark, sf), P)


@register("fixed_movement_report")
def q_fixed_movement_report(spark, sf):
    return M.movement_report(_fixed(spark, sf).base)


@register("repair_overdue")
def q_repair_overdue(spark, sf):
    rep = S.repair_overdue(population(_snap(spark, sf)), P)
    return rep.select("act_acct_cd", "dt", "fi_outst_age", "prev_mora", "next_mora", "mora_fix")


@register("fixed_table")
def q_fixed_table(spark, sf):
    return FX.select_fixed(_fixed(spark, sf).table)


@register("churn_counts")
def q_churn_counts(spark, sf):
    from churnlens.operators.churn import churn_counts
    return churn_counts(_fixed(spark, sf).table)


def _mobile_inputs(spark, sf):
    ev = T.load(spark, sf, "events")
    return T.mobile_register(ev), T.mobile_moves(ev)


MOBILE_COLS = ["mobile_month", "mobile_account", "mobile_active_bom", "mobile_active_eom", "b_fixed_contract",
               "e_fixed_contract", "b_mobile_mrc", "e_mobile_mrc", "b_correo", "b_start_date", "e_start_date",
               "b_mobile_tenure", "e_mobile_tenure", "b_mobile_tenure_segment", "e_mobile_tenure_segment",
               "fmc_account", "mobile_movement_flag", "mobile_churn_type", "mobile_churn_flag", "mobile_rgu_churn",
               "mobile_rejoiner_type"]


@register("mobile_table")
def q_mobile_table(spark, sf):
    from churnlens.operators.mobile import mobile_table
    reg, moves = _mobile_inputs(spark, sf)
    return mobile_table(reg, moves, P).select(*MOBILE_COLS)


@register("missing_clients")
def q_missing_clients(spark, sf):
    from churnlens.operators.mobile import clean_register, missing_clients
    reg, _ = _mobile_inputs(spark, sf)
    return missing_clients(clean_register(reg, P), P)


@register("rejoiner_window")
def q_rejoiner_window(spark, sf):
    from churnlens.operators.churn import rejoiner_window
    return rejoiner_window(_fixed(spark, sf).base, P, periods=1)


@register("rejoiner_population")
def q_rejoiner_population(spark, sf):
    from churnlens.operators.churn import rejoiner_pool, rejoiner_population
    return rejoiner_population(rejoiner_pool(_fixed(spark, sf).base, P))


@register("effective_rejoiners")
def q_effective_rejoiners(spark, sf):
    from churnlens.operators.churn import effective_rejoiners, rejoiner_pool
    base = _fixed(spark, sf).base
    return effective_rejoiners(rejoiner_pool(base, P), base, P)


FMC_COLS = ["month", "final_account", "fixed_account", "mobile_account", "final_bom_active_flag",
            "final_eom_active_flag", "b_fmc_status", "e_fmc_status", "contracts_fix", "b_fmc_type", "e_fmc_type",
            "b_final_tech_flag", "e_final_tech_flag", "b_tenure_final_flag", "e_tenure_final_flag", "b_fmc_segment",
            "e_fmc_segment", "final_churn_flag", "b_total_mrc", "e_total_mrc", "b_total_rgus", "e_total_rgus",
            "mrc_change", "total_rgu_churn", "rejoiner_final_flag", "partial_total_churn_flag",
            "churn_type_final_flag", "waterfall_flag", "b_plan_full", "e_plan_full", "downsell_split",
            "downspin_split", "b_email", "b_contr"]


def _near(spark, sf):
    from churnlens.operators import convergence as V
    ev = T.load(spark, sf, "events")
    return V.email_match(T.mobile_register(ev), V.fixed_emails(T.fixed_snapshot(ev)))


def _fmc(spark, sf):
    from churnlens.operators import convergence as V
    from churnlens.operators.mobile import mobile_table
    reg, moves = _mobile_inputs(spark, sf)
    mob = V.attach_near(mobile_table(reg, moves, P), _near(spark, sf), P)
    return V.fmc_table(_fixed(spark, sf).table, mob)


@register("email_match")
def q_email_match(spark, sf):
    return _near(spark, sf).select("near_line", "near_file", "email", "contr")


def _near_dated(spark, sf):
    from churnlens.functions.keys import DUMMY_EMAILS_DATED
    from churnlens.operators import convergence as V
    ev = T.load(spark, sf, "events")
    fixed = V.fixed_emails(T.fixed_snapshot(ev), dummies=DUMMY_EMAILS_DATED, day="dt")
    return V.email_match(T.mobile_register(ev), fixed, dummies=DUMMY_EMAILS_DATED)


def _resolved(spark, sf):
    from churnlens.operators import convergence as V
    from churnlens.operators.mobile import mobile_table
    reg, moves = _mobile_inputs(spark, sf)
    return V.resolve_contract(V.attach_near(mobile_table(reg, moves, P), _near_dated(spark, sf), P))


@register("email_match_dated")
def q_email_match_dated(spark, sf):
    return _near_dated(spark, sf)


@register("contract_resolution")
def q_contract_resolution(spark, sf):
    return _resolved(spark, sf).select("mobile_month", "mobile_account", "b_contr", "e_contr", "b_contract_adj",
                                       "e_contract_adj", "contract_adj", "fixed_count")


@register("fmc_base_resolved")
def q_fmc_base_resolved(spark, sf):
    from churnlens.operators.convergence import fmc_base_resolved
    return fmc_base_resolved(_fixed(spark, sf).table, _resolved(spark, sf)).select(
        "month", "final_account", "fixed_account", "mobile_account", "final_bom_active_flag", "final_eom_active_flag",
        "b_fmc_status", "e_fmc_status", "contracts_fix", "b_total_mrc", "e_total_mrc")


@register("fmc_table")
def q_fmc_table(spark, sf):
    t = _fmc(spark, sf)
    r4 = ["b_total_mrc", "e_total_mrc", "b_total_rgus", "e_total_rgus", "total_rgu_churn"]
    return t.withColumns({c: F.round(c, 4) for c in r4}).select(*FMC_COLS)


@register("fmc_grouped")
def q_fmc_grouped(spark, sf):
    from churnlens.operators.convergence import fmc_grouped
    return fmc_grouped(_fmc(spark, sf), ["month", "e_fmc_segment", "e_fmc_type", "e_final_tech_flag", "waterfall_flag"])


@register("fmc_packing")
def q_fmc_packing(spark, sf):
    from churnlens.operators.convergence import fmc_packing
    return fmc_packing(_fmc(spark, sf), P)


def _driver_inputs(spark, sf):
    ev = T.load(spark, sf, "events")
    return T.fixed_snapshot(ev), T.interactions(ev), T.service_orders(ev)


@register("driver_summary")
def q_driver_summary(spark, sf):
    from churnlens.plans import drivers as DP
    snap, inter, orders = _driver_inputs(spark, sf)
    return DP.driver_summary(DP.drivers_master(_fmc(spark, sf), snap, inter, orders, P))


@register("contact_tiers")
def q_contact_tiers(spark, sf):
    from churnlens.plans import drivers as DP
    _, inter, _ = _driver_inputs(spark, sf)
    return DP.contact_summary(DP.contact_master(_fmc(spark, sf), inter, P))


FUNNEL_STAGES = (("overdue", 2, None, "fi_outst_age_final", 0), ("soft_dx", 3, None, "fi_outst_age_final", 0),
                 ("hard_dx", 4, None, "fi_outst_age_final", 1))
FUNNEL_BANDS = (("day_one", (("fi_outst_age_final", 1, 2),)), ("soft_dx", (("fi_outst_age_final", 3, 3),)),
                ("backlog", (("fi_outst_age_final", 2, None), ("fi_outst_age", None, 5))), ("hard_dx", (("fi_outst_age", 6, 7),)))


@register("overdue_from_payment")
def q_overdue_from_payment(spark, sf):
    from churnlens.operators.billing import overdue_from_payment
    return overdue_from_payment(_snap(spark, sf), P).select(
        "act_acct_cd", "dt", "oldest_unpaid_bill_final", "fi_outst_age_final")


@register("debt_funnel")
def q_debt_funnel(spark, sf):
    from churnlens.operators.billing import debt_funnel, overdue_from_payment
    return debt_funnel(overdue_from_payment(_snap(spark, sf), P), P, FUNNEL_STAGES)


@register("debt_funnel_bands")
def q_debt_funnel_bands(spark, sf):
    from churnlens.operators.billing import debt_bands, overdue_from_payment
    return debt_bands(overdue_from_payment(_snap(spark, sf), P), P, FUNNEL_BANDS, cohort_max=6)


@register("retention_funnel")
def q_retention_funnel(spark, sf):
    from churnlens.operators.billing import retention_funnel
    return retention_funnel(T.retention_requests(T.load(spark, sf, "events")), _fmc(spark, sf), P)


def _bills(spark, sf):
    return T.bills(T.load(spark, sf, "orders")), T.bill_moves(T.load(spark, sf, "lineitem"))


# billing and payments run monthly on the orders tables (1995-2001)
MONTHLY = T.TEST_PARAMS.with_(grain=Grain("month"))


@register("bill_payments")
def q_bill_payments(spark, sf):
    from churnlens.operators.billing import bill_payments
    b, m = _bills(spark, sf)
    return bill_payments(b, m, MONTHLY)


@register("oldest_unpaid_bill")
def q_oldest_unpaid_bill(spark, sf):
    from churnlens.operators.billing import bill_payments, oldest_unpaid
    orders = T.load(spark, sf, "orders")
    first = bill_payments(T.cycle_bills(orders), T.cycle_moves(orders), MONTHLY)
    return oldest_unpaid(T.crm_days(orders), first, MONTHLY)


@register("payment_reconciliation")
def q_payment_reconciliation(spark, sf):
    from churnlens.operators.billing import reconcile
    b, m = _bills(spark, sf)
    return reconcile(b, m)


@register("payment_sources")
def q_payment_sources(spark, sf):
    from churnlens.operators.billing import bill_payments, reconcile_payments
    orders = T.load(spark, sf, "orders")
    moves = T.cycle_moves(orders)
    return reconcile_payments(T.cycle_payments(orders), bill_payments(T.cycle_bills(orders), moves, MONTHLY), moves)


@register("voluntary_flag_count")
def q_voluntary_flag_count(spark, sf):
    from churnlens.operators.mobile import voluntary_flag_count
    return voluntary_flag_count(T.postpaid_lines(T.load(spark, sf, "events")), "2024-15-01")


EARLY_BANDS = (("calls_early", "day", 0, 2), ("calls_late", "day", 0, 9), ("calls_periods_1_3", "period", 1, 3))


def _early_bands(spark, sf, anchor):
    from churnlens.operators import drivers as D
    snap = T.fixed_snapshot(T.load(spark, sf, "events"))
    starts = snap.select(F.col("act_acct_cd").alias("account"), F.col("act_acct_inst_dt").alias("start"))
    calls = D.calls(T.interactions(T.load(spark, sf, "events")))
    return D.contacts_after_start(calls, starts, EARLY_BANDS, P, anchor)


@register("early_contacts_by_start")
def q_early_contacts_by_start(spark, sf):
    return _early_bands(spark, sf, "start")


@register("early_contacts_by_event")
def q_early_contacts_by_event(spark, sf):
    return _early_bands(spark, sf, "event")


TEST_STATUSES, TEST_TYPES = ("ACTIVO", "SUSPENDIDO"), ("RESIDENCIAL",)  # of the test snapshot


@register("clean_tickets")
def q_clean_tickets(spark, sf):
    from churnlens.operators.tickets import clean_tickets
    return clean_tickets(T.ticket_register(T.load(spark, sf, "events")))


@register("early_tickets_two_systems")
def q_early_tickets_two_systems(spark, sf):
    from churnlens.operators.tickets import early_tickets_two_systems
    ev = T.load(spark, sf, "events")
    return early_tickets_two_systems(T.ticket_register(ev), T.country_calls(ev), T.fixed_snapshot(ev), P, weeks=1, since="2024-01-02",
                                     statuses=TEST_STATUSES, types=TEST_TYPES)


@register("rgu_movement_report")
def q_rgu_movement_report(spark, sf):
    return M.rgu_movement_report(M.gain_movement(_fixed(spark, sf).base, P))


@register("churn_by_end_records")
def q_churn_by_end_records(spark, sf):
    from churnlens.operators.churn import churn_flags, involuntary_by_end_records
    st = _fixed(spark, sf)
    return churn_flags(st.base, involuntary_by_end_records(st.repaired, P), late_after=6).select(
        "fixed_month", "fixed_account", "fixed_churn_flag", "fixed_churn_type_flag", "churn_tenure_days", "churn_tenure_segment")


@register("churners_by_deinstallation")
def q_churners_by_deinstallation(spark, sf):
    from churnlens.operators.churn import churners_by_deinstallation, facts_from_summary, involuntary_churn
    st = _fixed(spark, sf)
    invol = involuntary_churn(facts_from_summary(st.summary), P)
    return churners_by_deinstallation(st.base, T.service_orders(T.load(spark, sf, "events")), invol, P)


@register("mobile_movement_presto")
def q_mobile_movement_presto(spark, sf):
    from churnlens.operators.mobile import clean_register, mobile_base
    reg, _ = _mobile_inputs(spark, sf)
    return mobile_base(clean_register(reg, P), P, variant="presto").groupBy("mobile_month", "mobile_movement_flag").agg(
        F.count_distinct("mobile_account").alias("lines"), F.count(F.lit(1)).alias("n_rows"))


SEGMENTS = ["e_fmc_segment", "e_fmc_type", "e_final_tech_flag", "e_tenure_final_flag"]


@register("driver_segments")
def q_driver_segments(spark, sf):
    from churnlens.plans import drivers as DP
    snap, inter, orders = _driver_inputs(spark, sf)
    return DP.driver_summary(DP.drivers_master(_fmc(spark, sf), snap, inter, orders, P), by=SEGMENTS)


@register("contact_segments")
def q_contact_segments(spark, sf):
    from churnlens.plans import drivers as DP
    _, inter, _ = _driver_inputs(spark, sf)
    return DP.contact_summary(DP.contact_master(_fmc(spark, sf), inter, P), by=SEGMENTS)


@register("all_null_accounts")
def q_all_null_accounts(spark, sf):
    from churnlens.operators.quality import all_null_accounts
    return all_null_accounts(_snap(spark, sf), P)


@register("intermittent_products")
def q_intermittent_products(spark, sf):
    from churnlens.operators.quality import intermittent
    return intermittent(_snap(spark, sf), P)


@register("overdue_histogram")
def q_overdue_histogram(spark, sf):
    from churnlens.operators.quality import overdue_histogram
    return overdue_histogram(S.repair_overdue(population(_snap(spark, sf)), P), P)


def _dedup(spark, sf):
    from churnlens.operators.drivers import dedupe_interactions
    return dedupe_interactions(T.interactions(T.load(spark, sf, "events")))


def _raw_billing(spark, sf):
    """Billing calls as the ticket source holds them (no daily dedupe)."""
    from churnlens.operators.drivers import billing_calls
    return billing_calls(T.interactions(T.load(spark, sf, "events")))


def _kpi_master(spark, sf):
    from churnlens.operators.drivers import bill_shock_flags
    return bill_shock_flags(_fmc(spark, sf), P)


@register("first_time_resolution")
def q_first_time_resolution(spark, sf):
    from churnlens.operators import kpi as K
    return K.first_time_resolution(_raw_billing(spark, sf), P)


def _kpi_sums(spark, sf, master):
    from churnlens.operators import kpi as K
    counts = K.account_counts(T.interactions(T.load(spark, sf, "events")), P)
    return K.kpi_sums(master, counts, K.first_time_resolution(_raw_billing(spark, sf), P))


def _kpi_rows(spark, sf):
    from churnlens.operators import kpi as K
    return K.kpi_table(_kpi_sums(spark, sf, _kpi_master(spark, sf)), "TEST", P)


@register("kpi_table")
def q_kpi_table(spark, sf):
    return _kpi_rows(spark, sf)


@register("kpi_overall")
def q_kpi_overall(spark, sf):
    from churnlens.operators.kpi import kpi_overall
    return kpi_overall(_kpi_rows(spark, sf))


CX_MASTER = ["month", "final_account", "fixed_account", "final_churn_flag", "main_movement", "contracts_fix", "b_num_rgus",
             "b_total_mrc", "mrc_change", "b_plan", "e_plan", "b_plan_full", "e_plan_full"]


def _cx_dashboard(spark, sf):
    from churnlens.operators import kpi as K
    from churnlens.operators.drivers import bill_shock_flags
    from churnlens.plans import drivers as DP
    from churnlens.plans.staging import stage
    snap, inter, orders = _driver_inputs(spark, sf)
    master = stage(_fmc(spark, sf).select(*CX_MASTER), "cx-master")
    drivers = DP.driver_summary(DP.drivers_master(master, snap, inter, orders, P))
    contacts = DP.contact_summary(DP.contact_master(master, inter, P))
    sums = _kpi_sums(spark, sf, bill_shock_flags(master, P))
    service = K.service_delivery(T.service_delivery_weekly(orders), P)
    return K.cx_dashboard(sums, drivers, contacts, service, "TT", "Test")


@register("cx_dashboard")
def q_cx_dashboard(spark, sf):
    return _cx_dashboard(spark, sf)


@register("cx_dashboard_overall")
def q_cx_dashboard_overall(spark, sf):
    from churnlens.operators.kpi import cx_overall
    return cx_overall(_cx_dashboard(spark, sf))


@register("churn_by_order")
def q_churn_by_order(spark, sf):
    from churnlens.operators.churn import churn_by_order
    snap, _, orders = _driver_inputs(spark, sf)
    return churn_by_order(orders, snap, P)


@register("churn_by_first_order")
def q_churn_by_first_order(spark, sf):
    from churnlens.operators.churn import churn_by_first_order
    _, _, orders = _driver_inputs(spark, sf)
    return churn_by_first_order(orders, P)


@register("gross_adds")
def q_gross_adds(spark, sf):
    return M.gross_adds(_snap(spark, sf), P)


@register("user_base_by_mix")
def q_user_base_by_mix(spark, sf):
    return M.user_base(_fixed(spark, sf).table)


@register("churn_by_order_type")
def q_churn_by_order_type(spark, sf):
    from churnlens.operators.churn import churn_by_order_type
    _, _, orders = _driver_inputs(spark, sf)
    b = churn_by_order_type(_fixed(spark, sf).base, orders, P)
    return (b.where(F.col("order_churn_type").isNotNull())
             .groupBy("fixed_month", "order_churn_type", "active_eom").agg(F.count(F.lit(1)).alias("accounts")))


@register("voluntary_counts")
def q_voluntary_counts(spark, sf):
    from churnlens.operators.churn import voluntary_counts
    _, _, orders = _driver_inputs(spark, sf)
    return voluntary_counts(orders)


@register("sales_channel")
def q_sales_channel(spark, sf):
    from churnlens.operators.drivers import sales_channel
    _, _, orders = _driver_inputs(spark, sf)
    return sales_channel(orders, P)


@register("sales_channel_groups")
def q_sales_channel_groups(spark, sf):
    """Channels with their group; the catalogue groups a channel by the word before its first blank or hyphen."""
    from churnlens.operators.drivers import sales_channel
    _, _, orders = _driver_inputs(spark, sf)
    group = F.upper(F.regexp_extract("channel_desc", "^[^ _-]+", 0))
    catalogue = orders.where(F.col("channel_desc").isNotNull()).select("channel_desc", group.alias("channel_group")).distinct()
    return sales_channel(orders, P, catalogue)


@register("mounting_bills")
def q_mounting_bills(spark, sf):
    from churnlens.operators.drivers import first_day_bills, mounting_bills
    days = first_day_bills(_snap(spark, sf), P)
    two = mounting_bills(days, P).withColumn("snapshots", F.lit(2))
    return two.unionByName(mounting_bills(days, P, 2).withColumn("snapshots", F.lit(3)))


RATE_FLAGS = ["early_issue_flag", "tech_call_flag", "soft_dx_flag", "never_paid_flag", "long_install_flag"]


@register("driver_percentages")
def q_driver_percentages(spark, sf):
    from churnlens.operators.drivers import flag_rate
    return flag_rate(q_driver_summary(spark, sf), RATE_FLAGS, "monthsale_flag")


@register("callers_by_month")
def q_callers_by_month(spark, sf):
    from churnlens.operators import drivers as D
    return D.caller_tiers_by_month(D.calls(T.interactions(T.load(spark, sf, "events"))), P)


@register("ticket_history")
def q_ticket_history(spark, sf):
    from churnlens import labels as L
    from churnlens.sources.io import union_history
    ev = T.load(spark, sf, "events")
    tk = (T.interactions(ev).where(F.col("interaction_purpose_descrip").isin(list(L.TECH_TICKET_PURPOSES)))
            .withColumn("fuente", F.lit("TICKETS")).withColumn("fecha", F.to_date("interaction_start_time")))
    so = (T.service_orders(ev).withColumn("fuente", F.lit("ORDENES"))
            .withColumn("order_id", F.col("order_id").cast("string")))
    return union_history([
        (tk, {"account_id": "contrato", "interaction_id": "tiquete", "fecha": "fecha_apertura",
              "interaction_status": "estado", "interaction_purpose_descrip": "clase", "fuente": "fuente"},
         F.year("fecha_apertura") == 2024),
        (so, {"account_name": "contrato", "order_id": "tiquete", "order_start_date": "fecha_apertura",
              "order_status": "estado", "order_type": "clase", "fuente": "fuente"},
         F.year("fecha_apertura") == 2024),
    ])


@register("backfill_product")
def q_backfill_product(spark, sf):
    from churnlens.sources.io import backfill_product
    out = backfill_product(_snap(spark, sf), "pd_vo_prod_nm", "2024-01-01", "2024-01-15", grain=P.grain)
    return out.select("act_acct_cd", "dt", "pd_vo_prod_nm")


@register("active_by_mrc")
def q_active_by_mrc(spark, sf):
    kept = S.active_by_mrc(_snap(spark, sf), P, mrc="fi_vo_mrc_amt")
    return kept.groupBy("month").agg(F.count(F.lit(1)).alias("rows_kept"),
                                     F.count_distinct("act_acct_cd").alias("accounts"))


@register("service_delivery")
def q_service_delivery(spark, sf):
    from churnlens.operators.kpi import service_delivery
    _, _, orders = _driver_inputs(spark, sf)
    return service_delivery(T.service_delivery_weekly(orders), MONTHLY)


@register("digital_payment_share")
def q_digital_payment_share(spark, sf):
    from churnlens.operators.kpi import digital_share
    return digital_share(T.payments(T.load(spark, sf, "lineitem")), MONTHLY)


@register("churn_order_matching")
def q_churn_order_matching(spark, sf):
    from churnlens.operators.churn import match_churn_order
    ev = T.load(spark, sf, "events")
    return match_churn_order(T.crm_churn_dates(ev), T.service_orders(ev), P, periods=3)


@register("voluntary_by_lines")
def q_voluntary_by_lines(spark, sf):
    from churnlens.operators.churn import voluntary_by_lines
    snap, _, orders = _driver_inputs(spark, sf)
    return voluntary_by_lines(T.voluntary_cancels(orders), snap, P)


@register("phone_match")
def q_phone_match(spark, sf):
    from churnlens.operators.convergence import phone_match
    snap = _snap(spark, sf)
    reg, _ = _mobile_inputs(spark, sf)
    return phone_match(T.fixed_contacts(snap), reg)


@register("household_match")
def q_household_match(spark, sf):
    from churnlens.operators.convergence import household_match
    from churnlens.operators.mobile import clean_register, mobile_base
    snap = _snap(spark, sf)
    reg, _ = _mobile_inputs(spark, sf)
    lines = reg.where(F.col("id_abonado") != "").select(
        F.col("fecha_parque").alias("dt"), F.replace("id_abonado", F.lit("."), F.lit("")).alias("mobile_account"))
    return household_match(T.with_household(snap, "act_acct_cd"), T.with_household(lines, "mobile_account", line_prefix=True),
                           _fixed(spark, sf).base, mobile_base(clean_register(reg, P), P), params=P)


@register("churn_by_crm")
def q_churn_by_crm(spark, sf):
    from churnlens.operators.churn import churn_by_crm
    return churn_by_crm(_snap(spark, sf), P, bb_days=2, other_days=4, early_days=7)


@register("fmc_patch")
def q_fmc_patch(spark, sf):
    from churnlens.operators.convergence import fmc_list_periods, patch_fmc
    listed = fmc_list_periods(T.fmc_list(T.load(spark, sf, "events")), P)
    return patch_fmc(_fmc(spark, sf), listed).select(
        "month", "final_account", "fmc_listed", "b_fmc_type_final", "e_fmc_type_final",
        "b_fmc_segment_final", "e_fmc_segment_final")


@register("scalar_functions")
def q_scalar_functions(spark, sf):
    """The scalar and window building blocks of section 2A on the snapshot:
    first non-null value so far (R71), last value with the default frame
    (R72), e-mail user part (R95), NaN-safe amount (R103), integer date key
    (R105), padded key (R91), days to month end (R114), month differences in
    both dialects (R112), absolute change (R117)."""
    from pyspark.sql import Window
    from churnlens.functions import keys as K
    s = _snap(spark, sf)
    w = Window.partitionBy("act_acct_cd").orderBy("dt")
    return s.select(
        "act_acct_cd", "dt",
        F.first("pd_vo_prod_nm", ignorenulls=True).over(w).alias("first_vo_name"),
        F.last("pd_tv_prod_nm").over(w).alias("tv_last_default_frame"),
        F.split_part("act_contact_mail_1", F.lit("@"), F.lit(1)).alias("email_user"),
        F.when(F.isnan("fi_bill_amt_m0"), F.lit(0.0)).otherwise(F.col("fi_bill_amt_m0")).alias("bill_nan_safe"),
        F.date_format("dt", "yyyyMMdd").cast("int").alias("date_key"),
        K.pad_key("act_acct_cd").alias("padded_key"),
        F.datediff(F.last_day("dt"), F.col("dt")).alias("days_to_month_end"),
        K.months_crossed("act_cust_strt_dt", F.add_months("dt", 1)).alias("months_crossed"),
        # from the first of the month: end-of-month rules differ between engines
        K.months_full(F.trunc("act_cust_strt_dt", "MM"), F.add_months("dt", 1)).alias("months_full"),
        F.abs(F.col("fi_vo_mrc_amt") - F.col("fi_tv_mrc_amt")).alias("abs_change"),
    )


@register("waterfall_bigquery")
def q_waterfall_bigquery(spark, sf):
    from churnlens.operators.convergence import waterfall_bigquery
    return waterfall_bigquery(_fmc(spark, sf)).select("month", "final_account", "waterfall_flag", "waterfall_bq")


@register("never_paid_sales")
def q_never_paid_sales(spark, sf):
    from churnlens.operators.churn import churn_by_crm, never_paid_by_churn
    snap = _snap(spark, sf)
    return never_paid_by_churn(snap, churn_by_crm(snap, P, bb_days=2, other_days=4, early_days=7), P, days=14)


@register("waterfall_jamaica")
def q_waterfall_jamaica(spark, sf):
    from churnlens.operators.convergence import waterfall_jamaica
    t = waterfall_jamaica(_fmc(spark, sf))
    return t.groupBy("month", "waterfall_jm").agg(F.count(F.lit(1)).alias("rows"),
                                                  F.count_distinct("final_account").alias("accounts"))
