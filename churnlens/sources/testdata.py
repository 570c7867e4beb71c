"""Adapters from the local test tables to the operators' input schemas.

The test tables hold no telecom data, so each adapter derives one input the
reference reads (see FIXTURES.md) from them, with Spark operations only:

* ``fixed_snapshot``  - daily account snapshot, one row per user and day of
  ``events``: products from event types, charges from ``value``, overdue age
  as days since the last payment (a ``purchase``), start date as the latest
  ``signup``.
* ``mobile_register`` - one row per mobile line and week from ``signup``
  events; text columns in the register's dirty formats.
* ``mobile_moves``    - disconnection reason per line and week from ``error``.
* ``interactions``    - every event as a customer interaction.
* ``service_orders``  - installs from ``signup``, uninstalls from large ``error``.
* ``bills`` / ``bill_moves`` / ``payments`` - from ``orders`` and ``lineitem``.

The test data spans 30 days, so the pipelines run them on a weekly grain and
with thresholds scaled to days (``TEST_PARAMS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.params import Grain, Params

WEEK = Grain("week")

# Thresholds for the 30-day test window (a week is the period; ages in days).
TEST_PARAMS = Params(
    grain=WEEK, invol_days=4, bom_max_overdue=4, eom_max_overdue=4,
    tenure_early=6, tenure_mid=12, soft_dx_days=2, never_paid_days=4,
    early_contact_days=3, early_ticket_weeks=1, outlier_install_days=6,
    contact_window_days=7, ftr_days=2, rejoiner_periods=2, young_account_days=7,
)

# Channel names of the test service orders, by floor(value) mod 4.
TEST_CHANNELS = ("TIENDA", "TELEVENTAS", "DIGITAL", "PUERTA A PUERTA")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _email(uid):
    # three users share an address
    return (F.when(uid % 25 == 0, F.lit("NOTIENE@GMAIL.COM"))
             .otherwise(F.concat(F.lit("user"), F.floor(uid / 3).cast("string"), F.lit("@mail.test"))))


def _phone(uid):
    return F.concat(F.lit("6"), F.lpad(uid.cast("string"), 7, "0"))


def _line_id(uid):
    return F.concat(F.lit("8."), F.lpad(uid.cast("string"), 6, "0"))


def fixed_snapshot(events: DataFrame) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    # keyed by the string account from the start, so the adapter's window and
    # the library's account windows share one hash partitioning
    g = (events.select(F.col("user_id").cast("string").alias("act_acct_cd"), "user_id", F.to_date("ts").alias("dt"),
                       "event_type", "value")
         .groupBy("act_acct_cd", "dt")
         .agg(F.max(F.when(t == "purchase", v)).alias("_vo"),
              F.sum(F.when(t == "purchase", v)).alias("_vo_amt"),
              F.max(F.when(t == "view", v)).alias("_tv"),
              F.sum(F.when(t == "view", v)).alias("_tv_amt"),
              F.max(F.when(t == "click", v)).alias("_bb"),
              F.sum(F.when(t == "click", v)).alias("_bb_amt"),
              F.sum(v).alias("_bill"),
              F.count(F.when(t.isin("purchase", "view", "click"), 1)).alias("_n_srv"),
              F.count(F.when(t == "signup", 1)).alias("_n_sign"),
              F.max(F.when(t == "error", v)).alias("_err"),
              F.max("user_id").alias("user_id")))
    w = Window.partitionBy("act_acct_cd").orderBy("dt")
    g = g.withColumns({
        "_last_pay": F.max(F.when(F.col("_vo_amt").isNotNull(), F.col("dt")))
                      .over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_start": F.coalesce(
            F.max(F.when(F.col("_n_sign") > 0, F.col("dt"))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.min("dt").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
        "_churn": F.max(F.when(F.col("_err") >= 150, F.col("dt"))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    uid = F.col("user_id")
    age = F.when(F.col("_vo_amt").isNull(), F.datediff("dt", "_last_pay"))

    def prod(c, hi, lo):
        return F.when(F.col(c).isNull(), F.lit(None).cast("string")).when(F.col(c) >= 50, F.lit(hi)).otherwise(F.lit(lo))

    return g.select(
        F.col("act_acct_cd"),
        F.col("dt"),
        F.lit("RESIDENCIAL").alias("act_cust_typ"),
        F.when(F.col("_n_srv") > 0, "ACTIVO").when(F.col("_n_sign") > 0, "SUSPENDIDO")
         .otherwise("CERRADO").alias("act_acct_stat"),
        prod("_vo", "VO PLUS", "VO BASIC").alias("pd_vo_prod_nm"),
        prod("_tv", "NextGen TV", "TV BASIC").alias("pd_tv_prod_nm"),
        prod("_bb", "FTTH PLUS", "HFC BASIC").alias("pd_bb_prod_nm"),
        prod("_bb", "FTTH", "HFC").alias("pd_bb_tech"),
        F.round(F.coalesce(F.col("_vo_amt"), F.lit(0.0)), 2).alias("fi_vo_mrc_amt"),
        F.round(F.coalesce(F.col("_tv_amt"), F.lit(0.0)), 2).alias("fi_tv_mrc_amt"),
        F.round(F.coalesce(F.col("_bb_amt"), F.lit(0.0)), 2).alias("fi_bb_mrc_amt"),
        F.round(F.col("_bill"), 2).alias("fi_bill_amt_m0"),
        age.cast("int").alias("fi_outst_age"),
        F.when(age.isNotNull(), F.date_add("_last_pay", 1)).alias("oldest_unpaid_bill_dt"),
        F.when(F.col("_vo_amt").isNotNull(), F.col("dt")).otherwise(F.col("_last_pay")).alias("lst_pymt_dt"),
        F.trunc("dt", "week").alias("bill_dt_m0"),
        F.datediff("dt", "_start").alias("c_cust_age"),
        F.col("_start").alias("act_cust_strt_dt"),
        F.col("_start").alias("act_acct_inst_dt"),
        F.col("_churn").alias("cst_chrn_dt"),
        _email(uid).alias("act_contact_mail_1"),
        _phone(uid).alias("act_contact_phone_1"),
    )


def mobile_register(events: DataFrame) -> DataFrame:
    s = events.where(F.col("event_type") == "signup").select("user_id", F.to_date("ts").alias("d"), "value")
    g = (s.groupBy("user_id", F.trunc("d", "week").alias("fecha_parque"))
          .agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_amt"), F.max("value").alias("_mx"),
               F.min("d").alias("_first")))
    g = g.withColumn("_first_user", F.min("_first").over(Window.partitionBy("user_id")))
    uid = F.col("user_id")
    # some rows are repeated, some come twice more without a line id
    copies = (F.when(uid % 7 == 0, F.array(F.lit(0), F.lit(0))).when(uid % 13 == 0, F.array(F.lit(0), F.lit(1), F.lit(1)))
               .otherwise(F.array(F.lit(0))))
    g = g.withColumn("_copy", F.explode(copies))
    return g.select(
        F.col("fecha_parque"),
        F.when(F.col("_copy") == 1, "").otherwise(_line_id(uid)).alias("id_abonado"),
        # the lines of two users share the even one's contract
        F.when(F.col("_n") >= 2, (uid - uid % 2).cast("string")).otherwise(F.lit("#N/D")).alias("contrato"),
        _phone(uid).alias("num_telefono"),
        _email(uid).alias("nom_email"),
        F.when(F.col("_mx") >= 300, F.lit("#N/D"))
         .otherwise(F.replace(F.round("_amt", 2).cast("string"), F.lit("."), F.lit(","))).alias("renta"),
        F.when(F.col("_mx") < 10, F.lit("ARTICULO SIN EQUIPO"))
         .otherwise(F.date_format("_first_user", "MM/dd/yyyy")).alias("fch_activacion"),
        F.when(F.col("_amt") > 500, F.lit("Empresas - Pymes")).otherwise(F.lit("Residencial"))
         .alias("des_segmento_cliente"),
    )


def mobile_moves(events: DataFrame) -> DataFrame:
    e = events.where(F.col("event_type") == "error")
    g = e.groupBy("user_id", F.trunc(F.to_date("ts"), "week").alias("dt")).agg(F.count(F.lit(1)).alias("_n"))
    return g.select(
        _line_id(F.col("user_id")).alias("id_abonado"),
        F.when(F.col("_n") == 1, "BAJA VOLUNTARIA").when(F.col("_n") == 2, "BAJA INVOLUNTARIA")
         .when(F.col("_n") == 3, "BAJA PORTABILIDAD").otherwise("ALTA/MIGRACION").alias("tipo_baja"),
        F.col("dt"),
    )


def interactions(events: DataFrame) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    purpose = (F.when((t == "error") & (v < 50), "AVERIAS")
                .when(t == "error", "SIN SERVICIO INTERNET")
                .when(t == "click", "FACTURACION/COBROS")
                .when(t == "view", "CONSULTA GENERAL")
                .when(t == "purchase", "VENTANILLA")
                .otherwise("VENTAS"))
    # some calls are followed by a void one of their day and purpose, some are reported again a day later
    copies = (F.when(v.between(100, 120), F.array(F.lit(0), F.lit(1)))
               .when((v > 120) & (v <= 140), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0))))
    e = events.withColumn("_copy", F.explode(copies))
    c, ts = F.col("_copy"), F.col("ts")
    return e.select(
        F.col("user_id").cast("string").alias("account_id"),
        F.lit("RESIDENCIAL").alias("account_type"),
        F.concat(F.col("event_id").cast("string"), F.when(c == 1, "v").otherwise("")).alias("interaction_id"),
        F.when(c == 1, ts + F.expr("INTERVAL 1 SECOND")).when(c == 2, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts)
         .alias("interaction_start_time"),
        purpose.alias("interaction_purpose_descrip"),
        F.when((c == 1) | (v > 270) & (v <= 300), "CANCELADA").when(v > 300, "ANULADA").otherwise("CERRADA")
         .alias("interaction_status"),
    )


def service_orders(events: DataFrame) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    fv = F.floor(v).cast("int")
    d = F.to_date("ts")
    chan = F.element_at(F.array(*[F.lit(c) for c in TEST_CHANNELS]), (fv % 4) + 1)
    o = events.where((t == "signup") | ((t == "error") & (v >= 100)))
    return o.select(
        F.col("event_id").alias("order_id"),
        F.col("user_id").cast("string").alias("account_name"),
        F.when(t == "signup", "INSTALACION").otherwise("DESINSTALACION").alias("order_type"),
        F.when(v >= 300, "CANCELADA").when(v >= 250, "ANULADA").otherwise("FINALIZADA").alias("order_status"),
        F.when(t == "signup", F.lit(None).cast("string"))
         .when(v >= 200, "MOROSIDAD").when(v >= 190, F.lit(None).cast("string")).otherwise("VOLUNTARIO").alias("order_reason"),
        d.alias("order_start_date"),
        F.date_add(d, fv % 10).alias("completed_date"),
        chan.alias("channel_desc"),
    )


def ticket_register(events: DataFrame) -> DataFrame:
    """Text register of the older ticket system: marks between the digits of
    account ids of 8, 10 or 12, day-first and month-first times, blank parts,
    tickets reported again a day later."""
    v, uid = F.col("value"), F.col("user_id")
    fv = F.floor(v)
    e = events.where(F.col("event_type") == "error").withColumn(
        "_copy", F.explode(F.when(v < 30, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    ts = F.col("ts") + F.make_dt_interval(days=F.col("_copy"))
    digits = lambda n: F.lpad(uid.cast("string"), n, "0")
    return e.select(
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("ticket_number"),
        F.when(uid % 5 == 0, F.concat(F.substring(digits(12), 1, 4), F.lit("-"), F.substring(digits(12), 5, 8)))
         .when(uid % 5 == 1, digits(10)).otherwise(F.concat(F.lit("A"), digits(8))).alias("account_id"),
        F.when(uid % 7 == 0, "Business").when(uid % 2 == 0, "RESIDENTIAL").otherwise("Residential HFC").alias("cust_type"),
        F.when(v.between(40, 50), "NETWORK MIGRATION").otherwise("STREET").alias("found_name"),
        F.when(fv % 4 == 0, "OPEN").otherwise("CLOSED").alias("status"),
        F.when(v.between(60, 70), F.date_format(ts, "/MM/yyyy HH:mm"))
         .when(fv % 3 == 0, F.date_format(ts, "MM/dd/yyyy HH:mm")).otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm"))
         .alias("received_time"))


def country_calls(events: DataFrame) -> DataFrame:
    """Interactions of the newer ticket system with a country and marked account ids."""
    n = F.col("account_id").cast("long") % 3
    return interactions(events).withColumns({
        "org_cntry": F.when(n == 0, "Jamaica").when(n == 1, "JAMAICA").otherwise("Barbados"),
        "account_id": F.concat(F.lit("J-"), F.col("account_id"))})


def bills(orders: DataFrame) -> DataFrame:
    """One bill per order: contract = customer, bill date = order date."""
    return orders.select(
        F.col("o_custkey").cast("string").alias("contrato"),
        F.col("o_orderkey").cast("string").alias("factura"),
        F.to_date("o_orderdate").alias("fecha_fact"),
        F.round("o_totalprice", 2).alias("monto_fact"),
    )


def _cycle_day():
    return F.date_add(F.trunc(F.to_date("o_orderdate"), "MM"), (F.col("o_custkey") % 28).cast("int"))


def cycle_bills(orders: DataFrame) -> DataFrame:
    """Bills dated the customer's own day of the month, as a billing cycle does."""
    return orders.select(F.col("o_custkey").cast("string").alias("contrato"), F.col("o_orderkey").cast("string").alias("factura"),
                         _cycle_day().alias("fecha_fact"), F.round("o_totalprice", 2).alias("monto_fact"))


def cycle_moves(orders: DataFrame) -> DataFrame:
    """Payments up to 80 days after a cycle bill; every fifth bill has none, invoice ids come zero-padded."""
    late = (F.col("o_orderkey") * 7 % 80).cast("int")
    return orders.where(F.col("o_orderkey") % 5 != 0).select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("fact_aplica"), F.date_add(_cycle_day(), late).alias("fecha_mov"),
        F.round("o_totalprice", 2).alias("monto_fact"))


def cycle_payments(orders: DataFrame) -> DataFrame:
    """The payment table's view of cycle bills: two documents per invoice, every third row repeated, some without an
    invoice, some a little short."""
    key, half = F.col("o_orderkey"), F.floor(F.col("o_totalprice") * 50) / 100
    copies = F.when(key % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    o = orders.withColumn("_doc", F.explode(copies))
    return o.select(
        F.concat(key.cast("string"), F.lit("-"), F.col("_doc").cast("string")).alias("payment_doc_id"),
        F.when(key % 11 == 0, "-1").otherwise(key.cast("string")).alias("invoice_id"),
        F.when((key % 4 == 0) & (F.col("_doc") == 1), F.lit(1.0)).otherwise(half).alias("payment_amt_local"))


def postpaid_lines(events: DataFrame) -> DataFrame:
    """Daily postpaid lines with a voluntary mark, dates as the file's text."""
    v, uid = F.col("value"), F.col("user_id")
    e = events.where(F.col("event_type").isin("error", "signup"))
    return e.select(
        F.to_date("ts").alias("dt"), F.when(v >= 20, "1.0").otherwise("0.0").alias("voluntary_flg"),
        F.when(uid % 5 == 0, "B2B").otherwise("B2C").alias("biz_unit_d"),
        F.when(uid % 7 == 0, "nan").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("inv_paymt_dt"),
        F.when(uid % 3 == 0, "nan").otherwise(F.date_format(F.date_add(F.to_date("ts"), (uid % 20).cast("int")), "yyyy-dd-MM"))
         .alias("stopdate_accountno"))


def crm_days(orders: DataFrame) -> DataFrame:
    """Snapshot days of customers around their cycle bills."""
    offset = F.explode(F.array(*[F.lit(n) for n in (-2, 0, 9, 24, 40, 65)])).alias("_n")
    return orders.select(F.col("o_custkey").cast("string").alias("act_acct_cd"), _cycle_day().alias("_d"), offset).select(
        "act_acct_cd", F.date_add("_d", F.col("_n")).alias("dt")).distinct()


def bill_moves(lineitem: DataFrame) -> DataFrame:
    """Payment movements: each shipped line pays part of its order's bill."""
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("fact_aplica"),
        F.to_date("l_shipdate").alias("fecha_mov"),
        # exact decimal arithmetic, so the 2-decimal rounding has no binary ties
        F.round(F.col("l_extendedprice").cast("decimal(9,2)") * (1 - F.col("l_discount").cast("decimal(3,2)"))
                * (1 + F.col("l_tax").cast("decimal(3,2)")), 2).cast("double").alias("monto_mov"),
    )


def retention_requests(events: DataFrame) -> DataFrame:
    """Disconnection requests from ``error`` events; large values were
    located (contacted), larger ones retained."""
    e = events.where(F.col("event_type") == "error")
    v = F.col("value")
    return e.select(
        F.col("user_id").cast("string").alias("contrato"),
        F.to_date("ts").alias("request_date"),
        F.when(v >= 100, "CONTACTO EFECTIVO").otherwise("NO CONTACTADO").alias("contactabilidad"),
        F.when(v >= 200, "RETENIDO").otherwise("NO RETENIDO").alias("solucion"),
    )


def service_delivery_weekly(orders: DataFrame) -> DataFrame:
    """Weekly service-delivery rows from the service orders: installations,
    mean time to install, truck rolls, mean time to repair, repairs per
    thousand subscribers and early-life-failure percentages; one OVERALL row
    and one per-network row per week."""
    d = F.datediff("completed_date", "order_start_date")
    inst = F.col("order_type") == "INSTALACION"
    unin = F.col("order_type") == "DESINSTALACION"
    done = F.col("order_status") == "FINALIZADA"
    w = (orders.groupBy(F.date_add(F.trunc("order_start_date", "week"), 6).alias("end_week_date"))
               .agg(F.count_distinct("account_name").alias("total_subscribers"),
                    F.count(F.when(inst & done, 1)).alias("assisted_installations"),
                    F.avg(F.when(inst & done, d)).alias("mtti"),
                    F.count(F.when(unin, 1)).alias("truck_rolls"),
                    F.avg(F.when(unin, d)).alias("mttr"),
                    F.try_divide(F.count(F.when(inst & ~done, 1)) * 100.0, F.count(F.when(inst, 1)))
                     .alias("i_elf_28days"),
                    F.try_divide(F.count(F.when(unin & ~done, 1)) * 100.0, F.count(F.when(unin, 1)))
                     .alias("r_elf_28days")))
    w = w.withColumn("scr", F.try_divide(F.col("truck_rolls") * 1000.0, F.col("total_subscribers")))
    overall = w.withColumn("network", F.lit("OVERALL"))
    hfc = w.withColumn("network", F.lit("HFC")).withColumn("assisted_installations", F.col("assisted_installations") * 2)
    return overall.unionByName(hfc)


def payments(lineitem: DataFrame) -> DataFrame:
    """Payment documents: one per shipped line; returned-flag N is digital."""
    return lineitem.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("payment_doc_id"),
        F.when(F.col("l_returnflag") == "N", "Digital").otherwise("No Digital").alias("digital_nondigital"),
        F.lit("B2C").alias("account_type"),
        F.to_date("l_shipdate").alias("dt"),
    )


def crm_churn_dates(events: DataFrame) -> DataFrame:
    """CRM churn date per account: the last large ``error`` event."""
    e = events.where((F.col("event_type") == "error") & (F.col("value") >= 150))
    return e.groupBy(F.col("user_id").cast("string").alias("account")).agg(F.max(F.to_date("ts")).alias("churn_date"))


def voluntary_cancels(orders: DataFrame) -> DataFrame:
    """Cancelled lines: voluntary uninstall orders, one line each."""
    c = orders.where((F.col("order_type") == "DESINSTALACION") & (F.col("order_reason") == "VOLUNTARIO"))
    return c.select(F.col("account_name").alias("src_account_id"), F.col("order_start_date").alias("cancel_date"),
                    F.lit("FIXED").alias("lob"))


def fixed_contacts(snap: DataFrame) -> DataFrame:
    """Three contact phones per account: the first is a stale number for odd
    accounts, the second a neighbour's, the third the account's own."""
    uid = F.col("act_acct_cd").cast("long")
    own = F.col("act_contact_phone_1")
    return snap.select("act_acct_cd").distinct().join(
        snap.groupBy("act_acct_cd").agg(F.min("act_contact_phone_1").alias("act_contact_phone_1")), "act_acct_cd") \
        .select("act_acct_cd",
                F.when(uid % 2 == 0, own).otherwise(F.lit("7000000")).alias("act_contact_phone_1"),
                F.concat(F.lit("6"), F.lpad((uid + 1).cast("string"), 7, "0")).alias("act_contact_phone_2"),
                own.alias("act_contact_phone_3"))


def with_household(df: DataFrame, key: str, line_prefix: bool = False) -> DataFrame:
    """Household of an account or line: four consecutive users share one
    (``line_prefix`` strips the leading 8 of a mobile line id)."""
    digits = F.regexp_replace(F.col(key).cast("string"), "^8", "") if line_prefix else F.col(key)
    return df.withColumn("household_id", (digits.cast("long") / 4).cast("long"))


def fmc_list(events: DataFrame) -> DataFrame:
    """External FMC list files, one per week: users with both a signup and a
    purchase in the week, with the first such day as the FMC start."""
    t = F.col("event_type")
    g = (events.groupBy(F.col("user_id"), F.trunc(F.to_date("ts"), "week").alias("dt"))
               .agg(F.min(F.when(t == "signup", F.to_date("ts"))).alias("_s"),
                    F.min(F.when(t == "purchase", F.to_date("ts"))).alias("_p"),
                    F.count(F.when(t == "signup", 1)).alias("_n")))
    g = g.where(F.col("_s").isNotNull() & F.col("_p").isNotNull())
    return g.select(
        F.col("user_id").cast("string").alias("account_no"),
        F.col("dt"),
        F.date_format(F.greatest("_s", "_p"), "MM/dd/yyyy").alias("fmc_start_date"),
        F.lit("Jamaica").alias("business_unit"),
        F.lit("Residential").alias("account_type"),
        F.when(F.col("_n") >= 3, "FMC").otherwise("Service Not Found").alias("service_type"),
    )
