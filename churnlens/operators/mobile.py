"""Mobile register: cleaning, opening/closing base, movements, churn reasons
and rejoiners (D03, D22, D50, D51, D52 mobile form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.cache import col
from churnlens import labels as L
from churnlens.functions.keys import blank_to_null, comma_decimal, parse_mixed_date, strip_dots
from churnlens.functions.rules import case_when, tenure_segment
from churnlens.operators.movement import full_periods, mobile_movement
from churnlens.params import Params


def clean_register(reg: DataFrame, params: Params = Params(), file_shift: int = 1,
                   date_formats=("MM/dd/yyyy",)) -> DataFrame:
    """Typed register rows (D03): the file of period p describes the opening
    of p + ``file_shift``; dots stripped from line ids; ``#N/D`` contracts,
    marker amounts and junk activation dates become NULL; business segments
    and rows without a line id are dropped, and repeated rows are one."""
    g = params.grain
    return (reg.where(~col("des_segmento_cliente").isin(list(L.BUSINESS_SEGMENTS)))
               .select(g.trunc(g.shift(col("fecha_parque").cast("date"), file_shift)).alias("month"),
                       strip_dots("id_abonado").alias("id_abonado"),
                       blank_to_null("contrato").alias("fixed_contract"),
                       col("num_telefono"), col("nom_email"),
                       comma_decimal("renta").alias("renta"),
                       parse_mixed_date("fch_activacion", date_formats, junk=L.ACTIVATION_JUNK).alias("start_date"))
               .where(F.coalesce(F.trim("id_abonado"), F.lit("")) != "").distinct())


def mobile_base(clean: DataFrame, params: Params = Params(), variant: str = "bigquery") -> DataFrame:
    """Full outer join of opening and closing lines on (line, period), with
    the movement of the given ``variant`` (D22)."""
    g = params.grain
    cols = ["fixed_contract", "renta", "num_telefono", "nom_email", "start_date"]
    names = {"fixed_contract": "fixed_contract", "renta": "mobile_mrc", "num_telefono": "num_telefono",
             "nom_email": "correo", "start_date": "start_date"}
    b = clean.select(col("month").alias("_bm"), col("id_abonado").alias("_bl"),
                     *[col(c).alias(f"b_{names[c]}") for c in cols])
    e = clean.select(g.shift(col("month"), -1).alias("_em"), col("id_abonado").alias("_el"),
                     *[col(c).alias(f"e_{names[c]}") for c in cols])
    j = b.join(e, (col("_bl") == col("_el")) & (col("_bm") == col("_em")), "full")
    out = j.select(F.coalesce("_bm", "_em").alias("mobile_month"), F.coalesce("_bl", "_el").alias("mobile_account"),
                   col("_bl").isNotNull().cast("int").alias("mobile_active_bom"),
                   col("_el").isNotNull().cast("int").alias("mobile_active_eom"),
                   *[col(f"{s}_{names[c]}") for s in ("b", "e") for c in cols])
    m = col("mobile_month")
    out = out.withColumns({
        "b_mobile_tenure": full_periods(g, "b_start_date", m),
        "e_mobile_tenure": full_periods(g, "e_start_date", m),
    })
    out = out.withColumns({
        "b_mobile_tenure_segment": tenure_segment("b_mobile_tenure", params.tenure_early, None, strict=True),
        "e_mobile_tenure_segment": tenure_segment("e_mobile_tenure", params.tenure_early, None, strict=True),
        "fmc_account": F.coalesce("b_fixed_contract", "e_fixed_contract", "mobile_account"),
    })
    return mobile_movement(out, params, variant=variant)


def churn_reasons(moves: DataFrame, params: Params = Params(), key: str = "id_abonado",
                  reason: str = "tipo_baja", day: str = "dt") -> DataFrame:
    """One churn type per (line, period) from the movement file; four reasons
    map to two types, involuntary wins when a line has both (D50)."""
    g = params.grain
    t = case_when([(col(reason) == r, lab) for r, lab in L.MOBILE_CHURN_REASONS])
    return (moves.select(strip_dots(key).alias("_ml"), g.trunc(col(day).cast("date")).alias("_mm"), t.alias("_t"))
                 .where(col("_t").isNotNull())
                 .groupBy("_ml", "_mm").agg(F.max("_t").alias("mobile_churn_type")))


def mobile_churn(base: DataFrame, reasons: DataFrame) -> DataFrame:
    """Lost lines (active at opening, absent at closing) with their reason;
    every row gets ``mobile_churn_flag`` and ``mobile_rgu_churn`` (D50)."""
    lost = (col("mobile_active_bom") == 1) & (col("mobile_active_eom") == 0)
    j = base.join(reasons, (col("mobile_account") == col("_ml")) & (col("mobile_month") == col("_mm")), "left")
    j = j.withColumn("mobile_churn_type", F.when(lost, col("mobile_churn_type")))
    return j.drop("_ml", "_mm").withColumns({
        "mobile_churn_flag": F.coalesce(col("mobile_churn_type"), F.lit(L.MOBILE_NONCHURNER)),
        "mobile_rgu_churn": col("mobile_churn_type").isNotNull().cast("int"),
    })


def mobile_rejoiners(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Lines that churned in p and have a row in p + 1 (D52, mobile form)."""
    g = params.grain
    ex = (df.where(col("mobile_churn_type").isNotNull())
            .select(col("mobile_account").alias("_ra"), g.shift(col("mobile_month"), 1).alias("_rm"),
                    case_when([(col("mobile_churn_type") == L.MOBILE_VOL, L.MOBILE_VOL_REJ),
                               (col("mobile_churn_type") == L.MOBILE_INVOL, L.MOBILE_INVOL_REJ)]).alias("_rt"))
            .groupBy("_ra", "_rm").agg(F.max("_rt").alias("mobile_rejoiner_type")))
    j = df.join(ex, (col("mobile_account") == col("_ra")) & (col("mobile_month") == col("_rm")), "left")
    return j.drop("_ra", "_rm")


def mobile_table(register: DataFrame, moves: DataFrame, params: Params = Params(), variant: str = "bigquery") -> DataFrame:
    base = mobile_base(clean_register(register, params), params, variant)
    return mobile_rejoiners(mobile_churn(base, churn_reasons(moves, params)), params)


def missing_clients(clean: DataFrame, params: Params = Params(), key: str = "fixed_contract") -> DataFrame:
    """Clients of the opening file that are missing from the closing file,
    counted per period (D51): anti-join of (client, period) sets."""
    g = params.grain
    b = clean.where(col(key).isNotNull()).select(col(key).alias("client"), col("month")).distinct()
    e = (clean.where(col(key).isNotNull())
              .select(col(key).alias("client"), g.shift(col("month"), -1).alias("month")).distinct())
    return (b.join(e, ["client", "month"], "left_anti").groupBy("month")
             .agg(F.count(F.lit(1)).alias("missing_clients")))


def voluntary_flag_count(lines: DataFrame, stopped_after: str, day: str = "dt", unit: str = "B2C") -> DataFrame:
    """Postpaid lines flagged voluntary per day (D43): consumer lines with a
    payment date whose stop date is unknown or later than ``stopped_after``
    (compared as the file writes it, year-day-month text)."""
    ok = ((col("voluntary_flg") == "1.0") & (col("biz_unit_d") == unit) & (col("inv_paymt_dt") != "nan")
          & ((col("stopdate_accountno") > stopped_after) | (col("stopdate_accountno") == "nan")))
    return lines.where(ok).groupBy(day).agg(F.count(F.lit(1)).alias("voluntary_lines"))
