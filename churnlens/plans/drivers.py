"""Drivers table: the convergence table enriched with every driver flag in
one join, then summarised per period (D80-D97)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import labels as L
from churnlens.operators import drivers as D
from churnlens.params import Params
from churnlens.plans.staging import stage

DRIVER_FLAGS = ["monthsale", "soft_dx", "never_paid", "long_install", "early_issue", "tech_call", "bill_claim",
                "mounting_bill"]


CONTACT_COLUMNS = ["account_id", "interaction_id", "interaction_start_time", "interaction_purpose_descrip", "interaction_status"]


def driver_flags(snap: DataFrame, inter: DataFrame, orders: DataFrame, params: Params) -> DataFrame:
    one = D.snapshot_driver_sets(snap, params, stage=stage)
    dedup = stage(D.dedupe_interactions(inter, void=L.VOID_STATUSES).select(*CONTACT_COLUMNS), "driver-contacts")

    def flag(df, name):
        return df.select("account", "month", F.lit(1).alias(name))

    return D.keyed_columns([
        flag(one["sales"], "monthsale"), one["risk"],
        flag(D.long_installs(orders, params), "long_install"),
        flag(D.early_contact(D.calls(dedup), one["starts"], params.early_contact_days, params), "early_issue"),
        flag(D.early_contact(D.tech_tickets(dedup), one["starts"], params.early_ticket_weeks, params, unit="week"), "tech_call"),
        flag(D.billing_claims(dedup, params), "bill_claim"),
        flag(one["mounting"], "mounting_bill"),
    ])


def drivers_master(master: DataFrame, snap: DataFrame, inter: DataFrame, orders: DataFrame,
                   params: Params) -> DataFrame:
    m = D.enrich(master, driver_flags(snap, inter, orders, params))
    return D.bill_shock_flags(m, params)


def driver_summary(master: DataFrame, by=()) -> DataFrame:
    cols = [f"{n}_flag" for n in DRIVER_FLAGS] + ["increase_flag", "no_plan_change_flag"]
    return D.driver_summary(master, cols, by=by)


def contact_master(master: DataFrame, inter: DataFrame, params: Params) -> DataFrame:
    """The master with contact tiers and ticket density; the deduplicated
    contacts are written once and each window is counted once for its tiers."""
    dedup = stage(D.dedupe_interactions(inter).select(*CONTACT_COLUMNS), "contacts")
    calls = D.tiers(D.contacts_in_window(dedup, D.calls(dedup), params), "call")
    tk = D.tech_tickets(dedup)
    tickets = D.tiers(D.contacts_in_window(tk, tk, params), "ticket")
    failed = D.failed_visits(dedup, params).withColumn("failed_visit", F.lit(1))
    m = D.enrich(master, D.keyed_columns([calls, tickets, failed]))
    dens = D.ticket_density(dedup, params).withColumnRenamed("account", "_da").withColumnRenamed("month", "_dm")
    return m.join(dens, (F.col("final_account") == F.col("_da")) & (F.col("month") == F.col("_dm")), "left") \
            .drop("_da", "_dm")


CONTACT_FLAGS = ["one_call_flag", "two_call_flag", "multiple_call_flag", "one_ticket_flag", "two_ticket_flag",
                 "multiple_ticket_flag", "failed_visit_flag"]


def contact_summary(master: DataFrame, by=()) -> DataFrame:
    """Contact tiers and ticket density per period and segment from one
    evaluation of the master: per (period, segment, account) first, then sums.
    A segment without a known account has no row."""
    by = list(by)
    m = master.where(~F.col("final_churn_flag").isin(list(D.EXCLUDED_CHURN)))
    per = m.groupBy("month", *by, "fixed_account").agg(
        *[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in CONTACT_FLAGS], F.sum("num_tech_tickets").alias("_n"))
    known = F.col("fixed_account").isNotNull()
    out = per.groupBy("month", *by).agg(
        F.count("fixed_account").alias("activebase"), *[F.sum(F.when(known, F.col(c))).cast("long").alias(c) for c in CONTACT_FLAGS],
        F.sum("_n").cast("long").alias("ticket_density"))
    return out.where("activebase > 0")
