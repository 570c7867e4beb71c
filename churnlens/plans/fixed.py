"""The fixed table: subscriber base, movements, churn and rejoiners.

snapshot -> population -> features -> repair  (one shuffle by account)
        -> opening / closing -> base (full join on account, period)
        -> movements, tenure, spin (column expressions)
        -> period facts (one aggregate) -> involuntary churn
        -> voluntary churn from the base, initial products (one aggregate)
        -> merge, attach, rejoiners, lost products, plans
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators import churn as C
from churnlens.operators import movement as M
from churnlens.operators import snapshot as S
from churnlens.params import Params
from churnlens.sources.io import population, with_checkpoint


@dataclass
class FixedStages:
    features: DataFrame
    repaired: DataFrame
    summary: DataFrame
    base: DataFrame
    table: DataFrame


def clean_keys(snap: DataFrame, key: str = "act_acct_cd", dedupe: bool = False) -> DataFrame:
    """Drop rows without an account key (they can join nothing, and a NULL or
    blank key would gather into one window partition). ``dedupe`` removes
    exact copies (the reference's ``SELECT DISTINCT``); the partial aggregate
    collapses copies inside each task before the shuffle, so a group of
    copies holding a large share of the rows never reaches one task whole."""
    out = snap.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != ""))
    return out.dropDuplicates() if dedupe else out


def fixed_stages(snap: DataFrame, params: Params = Params(), apply_population: bool = True,
                 materialize: bool = True, dedupe: bool = False) -> FixedStages:
    """The daily data is read once, shuffled once by account, and reduced to
    one row per (account, period) right after the repair window
    (``period_summary``). ``materialize`` checkpoints that summary (reliable
    checkpoint in ``spark.checkpoint.dir``): the base, churn facts, initial
    products and rejoiners all read it, and the checkpoint keeps its hash
    partitioning by account, so their joins need no further shuffle of it."""
    snap = clean_keys(snap, dedupe=dedupe)
    src = population(snap) if apply_population else snap
    feats = S.snapshot_features(src, params)
    rep = S.repair_overdue(feats, params)
    summary = S.period_summary(rep, params)
    if materialize:
        summary = with_checkpoint(summary)
    base = S.bom_eom_base(S.summary_side(summary, "b", params), S.summary_side(summary, "e", params))
    base = M.main_movement(base, params)
    base = M.tenure_segments(base, params)
    base = M.spin_movement(base)
    vol = C.voluntary_churn(base)
    facts = C.facts_from_summary(summary)
    invol = C.involuntary_churn(facts, params)
    churners = C.merge_churners(vol, invol, C.initial_rgus_from_summary(summary))
    table = C.attach_churn(base, churners)
    table = C.churn_tenure(table, params)
    table = C.rejoiners_from_summary(table, summary, params)
    table = C.fixed_rgu_churn(table)
    table = M.with_plans(table)
    return FixedStages(feats, rep, summary, base, table)


def fixed_table(snap: DataFrame, params: Params = Params()) -> DataFrame:
    return fixed_stages(snap, params).table


def movement_report(snap: DataFrame, params: Params = Params()) -> DataFrame:
    return M.movement_report(fixed_stages(snap, params).base)


FIXED_TABLE_COLUMNS = [
    "fixed_month", "fixed_account", "active_bom", "active_eom", "b_num_rgus", "e_num_rgus",
    "b_mix", "e_mix", "b_bundle_name", "e_bundle_name", "b_tech_flag", "e_tech_flag",
    "b_avg_mrc", "e_avg_mrc", "b_bill_amt", "e_bill_amt", "b_overdue", "e_overdue", "b_mora", "e_mora",
    "main_movement", "dif_total_rgu", "spin_movement", "b_fixed_tenure_segment", "e_fixed_tenure_segment",
    "fixed_churner_type", "invol_rgu_churn", "max_rgus_count", "churn_tenure_days",
    "fixed_rejoiner_type", "fixed_rgu_churn", "b_plan", "e_plan",
]


def select_fixed(table: DataFrame) -> DataFrame:
    return table.select(*FIXED_TABLE_COLUMNS)


def keyed(df: DataFrame) -> DataFrame:
    """Keys (account, period) with several rows, one for each pair of opening and closing plan rows."""
    return df.groupBy("fixed_month", "fixed_account").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
