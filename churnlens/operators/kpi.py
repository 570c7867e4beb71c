"""Customer-experience KPIs and the long KPI table (D110-D119).

Each KPI is a per-period numerator and denominator; the long table has one
row per (period, market, KPI) built with ``unionByName`` of small per-KPI
frames, so it never leaves Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import labels as L
from churnlens.functions.cache import col
from churnlens.functions.keys import pad_key
from churnlens.params import Params

KPI_COLS = ["month", "market", "kpi_name", "measure", "numerator", "denominator", "kpi_delay"]


def account_calls(events: DataFrame, params: Params = Params(), name: str = "n") -> DataFrame:
    """Distinct interactions per account and period."""
    g = params.grain
    return (events.where(col("account_id").isNotNull())
                  .groupBy(col("account_id").alias("account"), g.trunc(F.to_date("interaction_start_time")).alias("month"))
                  .agg(F.count_distinct("interaction_id").alias(name)))


def with_calls(master: DataFrame, calls: DataFrame, account: str = "fixed_account") -> DataFrame:
    """Left join of per-account counts on the padded account key and the period (one row per account and period)."""
    names = [c for c in calls.columns if c not in ("account", "month")]
    c = calls.select(pad_key(col("account")).alias("_ca"), col("month").alias("_cm"), *names)
    return master.join(c, (pad_key(col(account)) == col("_ca")) & (col("month") == col("_cm")), "left").drop("_ca", "_cm")


def master_calls(master: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """Calls of the master's accounts per period, each shared by the contract's fan-out (D110)."""
    j = with_calls(master, calls)
    return j.groupBy("month").agg(F.round(F.sum(col(name) / col("contracts_fix")), 4).alias(name))


def rgus_per_period(master: DataFrame) -> DataFrame:
    """Opening products of the master's accounts per period."""
    return master.groupBy("month").agg(F.sum("b_num_rgus").cast("double").alias("rgus"))


def per_thousand(num: DataFrame, den: DataFrame, num_col: str, den_col: str, kpi: str, market: str,
                 factor: float = 1000.0, digits: int = 4) -> DataFrame:
    """Contacts per 1,000 products (D110)."""
    j = num.join(den, "month", "inner")
    return j.select("month", F.lit(market).alias("market"), F.lit(kpi).alias("kpi_name"),
                    F.round(F.try_divide(col(num_col) * factor, col(den_col).cast("double")), digits).alias("measure"),
                    col(num_col).cast("double").alias("numerator"), col(den_col).cast("double").alias("denominator"),
                    F.lit("M-0").alias("kpi_delay"))


def ratio_kpi(df: DataFrame, num_col: str, den_col: str, kpi: str, market: str, digits: int = 4) -> DataFrame:
    """Monthly sums, then the ratio (D115)."""
    return df.select("month", F.lit(market).alias("market"), F.lit(kpi).alias("kpi_name"),
                     F.round(F.try_divide(col(num_col).cast("double"), col(den_col).cast("double")), digits)
                      .alias("measure"),
                     col(num_col).cast("double").alias("numerator"), col(den_col).cast("double").alias("denominator"),
                     F.lit("M-0").alias("kpi_delay"))


def calls_per_variation(billing_calls: DataFrame, master: DataFrame) -> DataFrame:
    """Accounts whose bill varies under an unchanged plan (``increase_flag``
    of the driver table) and the billing calls of those accounts (D111)."""
    j = with_calls(master.where(col("increase_flag").isNotNull()), billing_calls)
    return j.groupBy("month").agg(F.sum("num_calls").cast("long").alias("calls"),
                                  F.count_distinct("increase_flag").alias("variations"))


def account_counts(inter: DataFrame, params: Params = Params(), void=("ANULADA",)) -> DataFrame:
    """Distinct tech tickets, calls and billing calls per account and period
    from one pass over the interactions (D110, D111): one row per interaction
    with its marks, then sums, so no distinct count per kind."""
    p = col("interaction_purpose_descrip")
    live = inter.where(col("account_id").isNotNull() & col("interaction_id").isNotNull()
                       & ~col("interaction_status").isin(list(void)))
    marks = {"tickets": p.isin(list(L.TECH_TICKET_PURPOSES)), "calls": ~p.isin(list(L.NON_CALL_PURPOSES)),
             "billing": p.isin(list(L.BILLING_PURPOSES))}
    per = live.groupBy(col("account_id").alias("account"), params.grain.trunc(F.to_date("interaction_start_time")).alias("month"),
                       "interaction_id").agg(*[F.max(m.cast("int")).alias(n) for n, m in marks.items()])
    return per.groupBy("account", "month").agg(*[F.nullif(F.sum(n), F.lit(0)).alias(n) for n in marks])


def kpi_sums(master: DataFrame, counts: DataFrame, ftr: DataFrame) -> DataFrame:
    """Every numerator and denominator the master gives, one row per period,
    from one evaluation of it (D110-D112, D115).

    ``master`` carries ``increase_flag`` (``bill_shock_flags``). Its rows meet
    one table of per-account counts and are summed per account first, so that
    distinct accounts are plain counts; then per period."""
    both = counts.join(ftr, ["account", "month"], "full")
    j = with_calls(master, both)
    share = col("contracts_fix")
    varies = col("increase_flag").isNotNull()
    per = j.groupBy("month", "fixed_account").agg(
        F.sum("b_num_rgus").alias("rgus"), F.sum(col("tickets") / share).alias("tickets"), F.sum(col("calls") / share).alias("calls"),
        F.sum(F.when(varies, col("billing"))).alias("variation_calls"), F.max(varies.cast("int")).alias("varies"),
        F.sum(col("resolved") / share).alias("resolved"), F.sum(F.round(col("billing_calls") / share, 0)).alias("billing_calls"),
        F.max((col("main_movement") == L.MM_NEW).cast("int")).alias("new"))
    known = col("fixed_account").isNotNull().cast("int")
    return per.groupBy("month").agg(
        F.sum("rgus").cast("double").alias("rgus"), F.round(F.sum("tickets"), 4).alias("tickets"),
        F.round(F.sum("calls"), 4).alias("calls"), F.sum("variation_calls").cast("long").alias("variation_calls"),
        F.sum("varies").cast("long").alias("variations"), F.round(F.sum("resolved"), 4).alias("resolved"),
        F.sum("billing_calls").alias("billing_calls"), F.sum(F.coalesce(col("new"), F.lit(0)) * known).cast("long").alias("gross_adds"),
        F.sum(known).cast("long").alias("active_base"))


def unpivot(monthly: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """One row per period and KPI (D116): each dict gives the columns of one
    KPI as expressions over the period's row, with ``when`` telling whether the
    period has it. One ``inline`` of an array, so the periods are read once."""
    names = [n for n in rows[0] if n != "when"]
    array = F.array(*[F.struct(*[r[n].alias(n) for n in names], F.coalesce(r["when"], F.lit(False)).alias("_when")) for r in rows])
    return monthly.select(F.inline(array)).where("_when").drop("_when").distinct()


def kpi_row(kpi: str, num: str, den: str, market: str, factor: float = 1.0, digits: int = 4, when: Column | None = None,
            params: Params = Params(), delay: int = 0) -> dict[str, Column]:
    """Columns of the long KPI table for a ratio of two sums; ``delay`` reports it that many periods later (D118)."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return {"month": params.grain.shift(col("month"), delay), "market": F.lit(market), "kpi_name": F.lit(kpi),
            "measure": F.round(F.try_divide(n * factor, d), digits), "numerator": n, "denominator": d,
            "kpi_delay": F.lit(f"M-{delay}"), "when": F.lit(True) if when is None else when}


def placeholder_row(kpi: str, market: str) -> dict[str, Column]:
    """Columns of a KPI not yet measured (D117)."""
    none = F.lit(None).cast("double")
    return {"month": col("month"), "market": F.lit(market), "kpi_name": F.lit(kpi), "measure": none, "numerator": none,
            "denominator": none, "kpi_delay": F.lit("M-0"), "when": F.lit(True)}


def kpi_table(sums: DataFrame, market: str, params: Params = Params()) -> DataFrame:
    """The long KPI table of the master's sums (D116-D118)."""
    return unpivot(sums, [
        kpi_row("tech_tickets_per_1k_rgu", "tickets", "rgus", market, 1000.0),
        kpi_row("care_calls_per_1k_rgu", "calls", "rgus", market, 1000.0),
        kpi_row("billing_calls_per_bill_variation", "variation_calls", "variations", market, when=col("variations") > 0),
        kpi_row("first_time_resolution", "resolved", "billing_calls", market),
        kpi_row("first_time_resolution", "resolved", "billing_calls", market, params=params, delay=1),
        placeholder_row("nps_detractors", market), placeholder_row("digital_payment_share", market),
    ])


# KPIs of the customer-experience dashboard: name, facet, journey step, measure, numerator, denominator,
# digits of a ratio, factor, delay, source and size label.
CX_KPIS = (
    ("Gross_Adds", "contact_drivers", "buy", "gross_adds", 0, 0, None, 1, "M-0", "master", "large"),
    ("Active_Base", "contact_drivers", "use", "active_base", 0, 0, None, 1, "M-0", "master", "large"),
    ("Active_Base", "contact_drivers", "support-call", "active_base", 0, 0, None, 1, "M-0", "master", "large"),
    ("Tech_Tix_per_100_Acct", "contact_intensity", "use", None, "ticket_density", "contact_base", 4, 1, "M-0", "contacts", "large"),
    ("%Customers_w_MRC_Changes_5%+_excl_plan", "contact_drivers", "pay", None, "increase_flag", "no_plan_change_flag", 4, 1, "M-0", "drivers", "large"),
    ("%New_Sales_to_Soft_Dx", "high_risk", "buy", None, "soft_dx_flag", "monthsale_flag", 4, 1, "M-1", "drivers", "large"),
    ("%New_Customer_Callers_2+calls_21days", "high_risk", "buy", None, "early_issue_flag", "monthsale_flag", 4, 1, "M-1", "drivers", "large"),
    ("%breech_cases_install_6+days", "high_risk", "get", None, "long_install_flag", "monthsale_flag", 4, 1, "M-1", "drivers", "large"),
    ("%Early_Tech_Tix_-7weeks", "high_risk", "get", None, "tech_call_flag", "monthsale_flag", 4, 1, "M-2", "drivers", "large"),
    ("%Repeat_Callers_2+calls", "high_risk", "support-call", None, "repeat_callers", "contact_base", 4, 1, "M-2", "contacts", "large"),
    ("tech_calls_per_1k_rgu", "contact_intensity", "support-call", None, "tickets", "rgus", 0, 1000, "M-0", "master", "large"),
    ("care_calls_per_1k_rgu", "contact_intensity", "support-call", None, "calls", "rgus", 0, 1000, "M-0", "master", "large"),
    ("Billing Calls per Bill Variation", "contact_intensity", "pay", None, "variation_calls", "variations", 3, 1, "M-0", "master", "large"),
    ("%FTR_Billing", "effectiveness", "pay", None, "resolved", "billing_calls", 6, 1, "M-0", "master", "large"),
    ("%Customers_w_Mounting_Bills", "high_risk", "pay", "mounting_bill_flag", None, None, None, 1, "M-0", "drivers", "Large"),
    ("Installs", "contact_drivers", "get", "install", None, None, None, 1, "M-0", "service", "Large"),
    ("MTTI", "customer_time", "get", "mtti", None, None, None, 1, "M-0", "service", "Large"),
    ("%FTR_installs", "effectiveness", "get", "ftr_install", None, None, None, 1, "M-0", "service", "Large"),
    ("Repairs", "contact_drivers", "support-tech", "repairs", None, None, None, 1, "M-0", "service", "Large"),
    ("MTTR", "customer_time", "support-tech", "mttr", None, None, None, 1, "M-0", "service", "Large"),
    ("%FTR_Repair", "effectiveness", "support-tech", "ftr_repair", None, None, None, 1, "M-0", "service", "Large"),
    ("Repairs_per_1k_rgu", "contact_intensity", "support-tech", "repairs_1k_rgu", None, None, None, 1, "M-0", "service", "Large"),
)

# Dashboard KPIs without a source yet: name, facet, journey step.
CX_PLACEHOLDERS = (
    ("%eCommerce", "digital_shift", "buy"), ("tBuy", "NPS_Detractorship", "buy"), ("MTTB", "customer_time", "buy"),
    ("Buying_Calls/GA", "contact_intensity", "buy"), ("tInstall", "NPS_Detractorship", "get"),
    ("%self_installs", "digital_shift", "get"), ("Install_Calls/Installs", "contact_intensity", "get"),
    ("MTTBTR", "customer_time", "pay"), ("tpay", "NPS_Detractorship", "pay"), ("tHelp_Care", "NPS_Detractorship", "support-call"),
    ("%FRC_Care", "effectiveness", "support-call"), ("tHelp_repair", "NPS_Detractorship", "support-tech"),
    ("%_High_Tech_Call_Nodes_+6%monthly", "high_risk", "use"), ("pNPS", "NPS_Detractorship", "use"),
    ("%CC_SL_Care", "customer_time", "support-call"), ("%CC_SL_Tech", "customer_time", "support-call"),
    ("%Chatbot_containment_care", "digital_shift", "support-call"), ("%Chatbot_containment_Tech", "digital_shift", "support-tech"),
    ("%digital_payments", "digital_shift", "pay"),
)
CX_DIMS = ("month", "opco", "market", "market_size", "product", "biz_unit", "facet", "journey_waypoint", "kpi_name")


def cx_dashboard(sums: DataFrame, drivers: DataFrame, contacts: DataFrame, service: DataFrame, opco: str, market: str,
                 product: str = "Fixed", biz_unit: str = "B2C") -> DataFrame:
    """The customer-experience dashboard's long table (D116, D117): every KPI
    with its facet, journey step and product from four tables of one row per
    period - the master's sums, the driver summary, the contact summary and
    service delivery. A period has the KPIs of the sources that know it;
    placeholders stand in every period of the master."""
    monthly = sums.withColumn("_master", F.lit(True))
    contacts = contacts.select("month", col("activebase").alias("contact_base"), "ticket_density",
                               (col("two_call_flag") + col("multiple_call_flag")).alias("repeat_callers"))
    for name, part in (("drivers", drivers.drop("activebase")), ("contacts", contacts), ("service", service)):
        monthly = monthly.join(part.withColumn(f"_{name}", F.lit(True)), "month", "full")

    def number(x):
        return F.lit(None).cast("double") if x is None else col(x).cast("double") if isinstance(x, str) else F.lit(float(x))

    def row(kpi, facet, journey, meas, num, den, digits, factor, delay, source, size):
        n, d = number(num), number(den)
        value = number(meas) if digits is None else F.round(F.try_divide(n * F.lit(float(factor)), d), digits)
        return {"month": col("month"), "opco": F.lit(opco), "market": F.lit(market), "market_size": F.lit(size),
                "product": F.lit(product), "biz_unit": F.lit(biz_unit), "facet": F.lit(facet), "journey_waypoint": F.lit(journey),
                "kpi_name": F.lit(kpi), "kpi_meas": value, "kpi_num": n, "kpi_den": d, "kpi_delay": F.lit(delay),
                "when": col(f"_{source}")}

    return unpivot(monthly, [row(*k) for k in CX_KPIS] + [
        row(kpi, facet, journey, None, None, None, None, 1, "M-0", "master", "Large") for kpi, facet, journey in CX_PLACEHOLDERS])


def cx_overall(rows: DataFrame) -> DataFrame:
    """Overall values of the dashboard (D119): the measure where a KPI has
    neither sum, the safe ratio of the sums where it has both, else nothing;
    with year and month."""
    n, d = col("kpi_num"), col("kpi_den")
    value = F.when(n.isNull() & d.isNull(), F.sum("kpi_meas")).when(n.isNotNull() & d.isNotNull(), F.try_divide(F.sum(n), F.sum(d)))
    return rows.groupBy(*CX_DIMS, "kpi_num", "kpi_den").agg(
        F.round(value, 6).alias("kpi_meas"), F.coalesce(F.sum(n), F.lit(0.0)).alias("kpi_numm"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("kpi_denn")).drop("kpi_num", "kpi_den").withColumns({
            "network": F.lit("Overall"), "ref_year": F.year("month"), "ref_mo": F.month("month")}).distinct()


def first_time_resolution(billing: DataFrame, params: Params = Params(), days: int | None = None) -> DataFrame:
    """Billing calls solved at once, per account and period (D112): columns
    account, month, resolved, billing_calls (distinct interactions).

    A call is unsolved when another billing call of the account follows on
    its day or within ``days`` days. Of a day's unsolved calls only the one
    with the largest id is removed, and a day counts with one of the calls
    left, so a day of several calls counts as solved. The calls are reduced to one row per account and
    day first (``min``/``max`` of the id and the largest id but one), and a
    range frame looks ahead; the frame is partitioned by (account, period),
    each day copied into the periods whose calls it can follow, so a hot
    account is split by period."""
    g = params.grain
    n = params.ftr_days if days is None else days
    ids = billing.where(col("account_id").isNotNull()).select(
        col("account_id").alias("account"), F.to_date("interaction_start_time").alias("day"), "interaction_id").distinct()
    per_day = ids.groupBy("account", "day").agg(F.min("interaction_id").alias("lo"), F.max("interaction_id").alias("hi"))
    others = ids.join(per_day.select("account", "day", "hi"), ["account", "day"]).where(col("interaction_id") < col("hi"))
    second = others.groupBy("account", "day").agg(F.max("interaction_id").alias("second"))
    per_day = per_day.join(second, ["account", "day"], "left")
    u = per_day.withColumn("_p", F.explode(g.periods_covering(F.date_sub("day", n), col("day"))))
    epoch = F.datediff("day", F.lit("1970-01-01").cast("date"))
    ahead = Window.partitionBy("account", "_p").orderBy("_d").rangeBetween(1, n)
    u = u.withColumn("_d", epoch).withColumns({"_lo": F.min("lo").over(ahead), "_hi": F.max("hi").over(ahead)})
    follows = col("_lo").isNotNull() & ((col("_lo") != col("hi")) | (col("_hi") != col("hi")))
    solved = F.when(col("second").isNotNull(), col("second")).when(~follows, col("hi"))
    u = u.where(col("_p") == g.trunc(col("day"))).select("account", col("_p").alias("month"), solved.alias("solved"))
    done = u.groupBy("account", "month").agg(F.count_distinct("solved").alias("resolved"))
    return done.join(account_calls(billing, params, "billing_calls"), ["account", "month"])


def resolution_per_period(master: DataFrame, ftr: DataFrame) -> DataFrame:
    """Resolved and all billing calls of the master's accounts, shared by the fan-out; all calls rounded per row."""
    j = with_calls(master, ftr)
    return j.groupBy("month").agg(F.round(F.sum(col("resolved") / col("contracts_fix")), 4).alias("resolved"),
                                  F.sum(F.round(col("billing_calls") / col("contracts_fix"), 0)).alias("billing_calls"))


def shift_kpi(rows: DataFrame, periods: int, params: Params = Params()) -> DataFrame:
    """Report a KPI ``periods`` later (D118)."""
    g = params.grain
    return rows.withColumns({"month": g.shift(col("month"), periods), "kpi_delay": F.lit(f"M-{periods}")})


def kpi_placeholders(months: DataFrame, names: Sequence[str], market: str) -> DataFrame:
    """NULL-measure rows for KPIs not yet measured (D117): each period is
    expanded with the fixed KPI list (an array literal), no cross join."""
    arr = F.array(*[F.lit(n) for n in names])
    return months.select("month", F.explode(arr).alias("kpi_name")).select(
        "month", F.lit(market).alias("market"), "kpi_name", F.lit(None).cast("double").alias("measure"),
        F.lit(None).cast("double").alias("numerator"), F.lit(None).cast("double").alias("denominator"),
        F.lit("M-0").alias("kpi_delay"))


def kpi_long_table(parts: Sequence[DataFrame]) -> DataFrame:
    """Distinct union of all KPI rows (D116, D119 first half)."""
    out = None
    for p in parts:
        p = p.select(*KPI_COLS)
        out = p if out is None else out.unionByName(p)
    return out.distinct()


def kpi_overall(rows: DataFrame) -> DataFrame:
    """Per period and KPI: sum of the measure when there is no numerator and
    denominator, the safe ratio of the sums when both exist, else NULL,
    with year and month (D119)."""
    agg = rows.groupBy("month", "kpi_name").agg(
        F.sum("measure").alias("_m"), F.sum("numerator").alias("_n"), F.sum("denominator").alias("_d"),
        F.count("numerator").alias("_cn"), F.count("denominator").alias("_cd"))
    both_null = (col("_cn") == 0) & (col("_cd") == 0)
    both = (col("_cn") > 0) & (col("_cd") > 0)
    val = F.when(both_null, col("_m")).when(both, F.try_divide(col("_n"), col("_d")))
    return agg.select("month", F.year("month").alias("year"), F.month("month").alias("month_num"), "kpi_name",
                      F.round(val, 4).alias("overall"))


def service_delivery(weekly: DataFrame, params: Params = Params(), network: str = "OVERALL") -> DataFrame:
    """Installations, weighted mean times, repairs and first-time-right
    shares per period from weekly rows (D113): sums per week first, then per
    period, with the week's count as the weight of its mean time."""
    g = params.grain
    wk = (weekly.where(col("network") == network)
                .groupBy(g.trunc(col("end_week_date").cast("date")).alias("month"), "network", "end_week_date")
                .agg(F.sum("assisted_installations").alias("i"), F.sum("mtti").alias("t_i"),
                     F.sum("truck_rolls").alias("r"), F.sum("mttr").alias("t_r"), F.sum("scr").alias("scr"),
                     F.sum("i_elf_28days").alias("ie"), F.sum("r_elf_28days").alias("re")))
    wk = wk.withColumns({"inst_mtti": col("i") * col("t_i"), "rep_mttr": col("r") * col("t_r"),
                         "ftr_i": (100 - col("ie")) * col("i"), "ftr_r": (100 - col("re")) * col("r")})
    return wk.groupBy("month").agg(
        F.sum("i").cast("long").alias("install"),
        F.round(F.try_divide(F.sum("inst_mtti"), F.sum("i").cast("double")), 2).alias("mtti"),
        F.sum("r").cast("long").alias("repairs"),
        F.round(F.try_divide(F.sum("rep_mttr"), F.sum("r").cast("double")), 2).alias("mttr"),
        F.round(F.sum("scr"), 2).alias("repairs_1k_rgu"),
        F.round(F.try_divide(F.sum("ftr_i"), F.sum("i").cast("double")) / 100, 4).alias("ftr_install"),
        F.round(F.try_divide(F.sum("ftr_r"), F.sum("r").cast("double")) / 100, 4).alias("ftr_repair"))


def digital_share(payments: DataFrame, params: Params = Params(), market: str = "TEST",
                  account_type: str = "B2C") -> DataFrame:
    """Distinct digital payment documents over all documents per period (D114)."""
    g = params.grain
    p = payments.where(col("account_type") == account_type)
    agg = p.groupBy(g.trunc(col("dt").cast("date")).alias("month")).agg(
        F.count_distinct(F.when(col("digital_nondigital") == "Digital", col("payment_doc_id"))).alias("digital"),
        F.count_distinct("payment_doc_id").alias("pymt_cnt"))
    return agg.select("month", F.lit(market).alias("market"), F.lit("digital_payment_share").alias("kpi_name"),
                      F.round(F.try_divide(col("digital").cast("double"), col("pymt_cnt").cast("double")), 2)
                       .alias("measure"),
                      col("digital").cast("double").alias("numerator"),
                      col("pymt_cnt").cast("double").alias("denominator"), F.lit("M-0").alias("kpi_delay"))
