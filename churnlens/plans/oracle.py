"""DuckDB statements that restate each registered query in plain SQL.

They read the raw test tables (views ``events``, ``orders``, ``lineitem`` …)
and re-derive the adapters' inputs in SQL, so the check is independent of
the Spark code. Thresholds are the test parameters of
``churnlens.sources.testdata.TEST_PARAMS`` (weekly periods, ages in days).
"""

from __future__ import annotations


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


WK = "CAST(date_trunc('week', {}) AS DATE)"


def wk(x: str) -> str:
    return WK.format(x)


# --- adapter: daily account snapshot from events ---------------------------
SNAP = f"""
snap_g AS (
  SELECT user_id, CAST(ts AS DATE) AS dt,
         max(CASE WHEN event_type = 'purchase' THEN value END) AS _vo,
         sum(CASE WHEN event_type = 'purchase' THEN value END) AS _vo_amt,
         max(CASE WHEN event_type = 'view' THEN value END) AS _tv,
         sum(CASE WHEN event_type = 'view' THEN value END) AS _tv_amt,
         max(CASE WHEN event_type = 'click' THEN value END) AS _bb,
         sum(CASE WHEN event_type = 'click' THEN value END) AS _bb_amt,
         sum(value) AS _bill,
         count(CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 1 END) AS _n_srv,
         count(CASE WHEN event_type = 'signup' THEN 1 END) AS _n_sign,
         max(CASE WHEN event_type = 'error' THEN value END) AS _err
  FROM events GROUP BY user_id, CAST(ts AS DATE)
),
snap_w AS (
  SELECT *,
    max(CASE WHEN _vo_amt IS NOT NULL THEN dt END) OVER (PARTITION BY user_id ORDER BY dt
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _last_pay,
    coalesce(max(CASE WHEN _n_sign > 0 THEN dt END) OVER (PARTITION BY user_id ORDER BY dt
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(dt) OVER (PARTITION BY user_id)) AS _start,
    max(CASE WHEN _err >= 150 THEN dt END) OVER (PARTITION BY user_id ORDER BY dt
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _churn
  FROM snap_g
),
snap AS (
  SELECT CAST(user_id AS VARCHAR) AS act_acct_cd, dt, 'RESIDENCIAL' AS act_cust_typ,
    CASE WHEN _n_srv > 0 THEN 'ACTIVO' WHEN _n_sign > 0 THEN 'SUSPENDIDO' ELSE 'CERRADO' END AS act_acct_stat,
    CASE WHEN _vo IS NULL THEN NULL WHEN _vo >= 50 THEN 'VO PLUS' ELSE 'VO BASIC' END AS pd_vo_prod_nm,
    CASE WHEN _tv IS NULL THEN NULL WHEN _tv >= 50 THEN 'NextGen TV' ELSE 'TV BASIC' END AS pd_tv_prod_nm,
    CASE WHEN _bb IS NULL THEN NULL WHEN _bb >= 50 THEN 'FTTH PLUS' ELSE 'HFC BASIC' END AS pd_bb_prod_nm,
    CASE WHEN _bb IS NULL THEN NULL WHEN _bb >= 50 THEN 'FTTH' ELSE 'HFC' END AS pd_bb_tech,
    round(coalesce(_vo_amt, 0.0), 2) AS fi_vo_mrc_amt,
    round(coalesce(_tv_amt, 0.0), 2) AS fi_tv_mrc_amt,
    round(coalesce(_bb_amt, 0.0), 2) AS fi_bb_mrc_amt,
    round(_bill, 2) AS fi_bill_amt_m0,
    CAST(CASE WHEN _vo_amt IS NULL THEN date_diff('day', _last_pay, dt) END AS INTEGER) AS fi_outst_age,
    CASE WHEN _vo_amt IS NULL AND _last_pay IS NOT NULL THEN _last_pay + 1 END AS oldest_unpaid_bill_dt,
    CASE WHEN _vo_amt IS NOT NULL THEN dt ELSE _last_pay END AS lst_pymt_dt,
    {wk('dt')} AS bill_dt_m0,
    CAST(date_diff('day', _start, dt) AS INTEGER) AS c_cust_age,
    _start AS act_cust_strt_dt, _start AS act_acct_inst_dt, _churn AS cst_chrn_dt,
    CASE WHEN user_id % 25 = 0 THEN 'NOTIENE@GMAIL.COM'
         ELSE 'user' || CAST(user_id // 3 AS VARCHAR) || '@mail.test' END AS act_contact_mail_1,
    '6' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS act_contact_phone_1
  FROM snap_w
)
"""

# --- features, repair, opening/closing, base --------------------------------
FEAT = f"""
pop AS (
  SELECT * FROM snap
  WHERE act_cust_typ IN ('RESIDENCIAL', 'PROGRAMA HOGARES CONECTADOS') AND act_acct_stat IN ('ACTIVO', 'SUSPENDIDO')
),
feat1 AS (
  SELECT *, {wk('dt')} AS month,
    CASE WHEN coalesce(pd_vo_prod_nm, '') <> '' THEN 1 ELSE 0 END AS rgu_vo,
    CASE WHEN coalesce(pd_tv_prod_nm, '') <> '' THEN 1 ELSE 0 END AS rgu_tv,
    CASE WHEN coalesce(pd_bb_prod_nm, '') <> '' THEN 1 ELSE 0 END AS rgu_bb,
    CASE WHEN pd_bb_prod_nm LIKE '%FTTH%' OR (pd_tv_prod_nm = 'NextGen TV' AND pd_bb_prod_nm IS NULL)
         THEN 'FTTH' ELSE 'HFC' END AS tech_flag,
    round(fi_vo_mrc_amt + fi_bb_mrc_amt + fi_tv_mrc_amt, 0) AS avg_mrc,
    round(fi_bill_amt_m0, 0) AS bill,
    CAST(date_diff('day', oldest_unpaid_bill_dt, dt) AS INTEGER) AS mora,
    first_value(act_acct_inst_dt) OVER (PARTITION BY act_acct_cd ORDER BY dt) AS min_inst,
    max(act_acct_inst_dt) OVER (PARTITION BY act_acct_cd) AS max_inst,
    last_value(fi_outst_age) OVER (PARTITION BY act_acct_cd, {wk('dt')} ORDER BY dt
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_overdue,
    lag(fi_outst_age) OVER (PARTITION BY act_acct_cd ORDER BY dt) AS prev_mora,
    lead(fi_outst_age) OVER (PARTITION BY act_acct_cd ORDER BY dt) AS next_mora
  FROM pop
),
rep AS (
  SELECT *, rgu_vo + rgu_tv + rgu_bb AS num_rgus,
    CASE WHEN rgu_vo + rgu_tv + rgu_bb = 3 THEN '3P' WHEN rgu_vo + rgu_tv + rgu_bb = 2 THEN '2P'
         WHEN pd_vo_prod_nm IS NULL AND pd_tv_prod_nm IS NULL AND pd_bb_prod_nm IS NULL THEN '0P'
         ELSE '1P' END AS mix,
    CASE rgu_vo * 100 + rgu_tv * 10 + rgu_bb
         WHEN 100 THEN 'VO' WHEN 10 THEN 'TV' WHEN 1 THEN 'BB' WHEN 110 THEN 'TV+VO'
         WHEN 11 THEN 'BB+TV' WHEN 101 THEN 'BB+VO' WHEN 111 THEN 'BB+TV+VO' END AS bundle_name,
    CAST(CASE
      WHEN (fi_outst_age - prev_mora > 2 AND fi_outst_age - next_mora > 2)
        OR (fi_outst_age - prev_mora < -2 AND fi_outst_age - next_mora < -2) THEN prev_mora + 1
      WHEN fi_outst_age IS NULL AND next_mora = prev_mora + 2 THEN prev_mora + 1
      WHEN prev_mora IS NULL AND next_mora IS NULL THEN NULL
      ELSE fi_outst_age END AS INTEGER) AS mora_fix
  FROM feat1
)
"""


def _side(p: str) -> str:
    cols = [("act_contact_phone_1", "phone"), ("pd_vo_prod_nm", "vo_nm"), ("pd_tv_prod_nm", "tv_nm"),
            ("pd_bb_prod_nm", "bb_nm"), ("rgu_vo", "rgu_vo"), ("rgu_tv", "rgu_tv"), ("rgu_bb", "rgu_bb"),
            ("fi_outst_age", "overdue"), ("c_cust_age", "tenure"), ("min_inst", "min_inst"),
            ("max_inst", "max_inst"), ("mix", "mix"), ("num_rgus", "num_rgus"), ("tech_flag", "tech_flag"),
            ("mora", "mora"), ("avg_mrc", "avg_mrc"), ("bill", "bill_amt"),
            ("act_cust_strt_dt", "act_cust_strt_dt"), ("bundle_name", "bundle_name")]
    return ", ".join(f"{s} AS {p}_{d}" for s, d in cols)


BASE = f"""
bom AS (
  SELECT month AS bm, act_acct_cd AS account_b, dt AS b_date, {_side('b')}
  FROM rep WHERE dt = month AND (mora_fix <= 4 OR mora_fix IS NULL)
),
eom AS (
  SELECT CAST(month - 7 AS DATE) AS em, act_acct_cd AS account_e, dt AS e_date, {_side('e')}
  FROM rep WHERE dt = month AND (mora_fix < 4 OR mora_fix IS NULL)
),
base0 AS (
  SELECT coalesce(bm, em) AS fixed_month, coalesce(account_b, account_e) AS fixed_account,
         CASE WHEN account_b IS NOT NULL THEN 1 ELSE 0 END AS active_bom,
         CASE WHEN account_e IS NOT NULL THEN 1 ELSE 0 END AS active_eom, bom.*, eom.*
  FROM bom FULL OUTER JOIN eom ON account_b = account_e AND bm = em
),
base AS (
  SELECT *,
    CASE
      WHEN e_num_rgus - b_num_rgus = 0 THEN '01. Same RGUs'
      WHEN e_num_rgus - b_num_rgus > 0 THEN '02. Upsell'
      WHEN e_num_rgus - b_num_rgus < 0 THEN '03. Downsell'
      WHEN b_num_rgus IS NULL AND e_num_rgus > 0 AND {wk('e_act_cust_strt_dt')} <> fixed_month
           AND sign(date_diff('day', e_max_inst, fixed_month)) * floor(abs(date_diff('day', e_max_inst, fixed_month)) / 7) <= 1
        THEN '04. Come Back to Life'
      WHEN b_num_rgus IS NULL AND e_num_rgus > 0
           AND sign(date_diff('day', e_act_cust_strt_dt, fixed_month)) * floor(abs(date_diff('day', e_act_cust_strt_dt, fixed_month)) / 7) <= 1
        THEN '05. New Customer'
      WHEN active_bom = 1 AND active_eom = 0 THEN '06. Loss'
      WHEN b_num_rgus IS NULL AND e_num_rgus > 0 AND {wk('e_act_cust_strt_dt')} <> fixed_month THEN '07. Missing Customer'
    END AS main_movement,
    e_num_rgus - b_num_rgus AS dif_total_rgu,
    CASE WHEN b_tenure <= 6 THEN 'Early Tenure' WHEN b_tenure <= 12 THEN 'Mid Tenure'
         WHEN b_tenure IS NOT NULL THEN 'Late Tenure' END AS b_fixed_tenure_segment,
    CASE WHEN e_tenure <= 6 THEN 'Early Tenure' WHEN e_tenure <= 12 THEN 'Mid Tenure'
         WHEN e_tenure IS NOT NULL THEN 'Late Tenure' END AS e_fixed_tenure_segment
  FROM base0
)
"""

CHURN = f"""
last_rec AS (
  SELECT act_acct_cd, month, mora_fix AS last_mora_fix, fi_outst_age AS last_raw, dt AS last_record
  FROM (SELECT *, row_number() OVER (PARTITION BY act_acct_cd, month ORDER BY dt DESC) AS rn FROM rep) WHERE rn = 1
),
facts AS (
  SELECT r.act_acct_cd, r.month,
    max(CASE WHEN mora_fix < 4 THEN 1 ELSE 0 END) AS any_below,
    max(CASE WHEN pd_vo_prod_nm IS NOT NULL THEN 1 ELSE 0 END) + max(CASE WHEN pd_bb_prod_nm IS NOT NULL THEN 1 ELSE 0 END)
      + max(CASE WHEN pd_tv_prod_nm IS NOT NULL THEN 1 ELSE 0 END) AS invol_rgu_churn,
    max(max_inst) AS max_inst
  FROM rep r GROUP BY r.act_acct_cd, r.month
),
invol AS (
  SELECT f.month AS i_month, f.act_acct_cd AS i_acct, '2. Fixed Involuntary Churner' AS invol_churner,
         f.invol_rgu_churn, CAST(date_diff('day', f.max_inst, l.last_record) AS INTEGER) AS churn_tenure_days
  FROM facts f JOIN last_rec l ON f.act_acct_cd = l.act_acct_cd AND f.month = l.month
  WHERE f.any_below = 1 AND l.last_mora_fix >= 4 AND l.last_raw >= 4
),
first_rec AS (
  SELECT act_acct_cd AS r_acct,
    (CASE WHEN pd_vo_prod_nm IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN pd_bb_prod_nm IS NOT NULL THEN 1 ELSE 0 END)
      + (CASE WHEN pd_tv_prod_nm IS NOT NULL THEN 1 ELSE 0 END) AS max_rgus_count
  FROM (SELECT *, row_number() OVER (PARTITION BY act_acct_cd ORDER BY dt) AS rn FROM pop) WHERE rn = 1
),
vol AS (
  SELECT fixed_month AS v_month, fixed_account AS v_acct, '1. Fixed Voluntary Churner' AS vol_churner, max_rgus_count
  FROM base LEFT JOIN first_rec ON r_acct = fixed_account
  WHERE active_bom = 1 AND active_eom = 0
),
churners AS (
  SELECT coalesce(i_month, v_month) AS churn_month, coalesce(i_acct, v_acct) AS churn_account,
         coalesce(invol_churner, vol_churner) AS ctype, invol_rgu_churn, max_rgus_count, churn_tenure_days
  FROM vol FULL OUTER JOIN invol ON v_month = i_month AND v_acct = i_acct
),
t1 AS (
  SELECT base.*, CASE WHEN active_eom = 1 THEN NULL ELSE ctype END AS fixed_churner_type,
         invol_rgu_churn, max_rgus_count, churn_tenure_days
  FROM base LEFT JOIN churners ON fixed_month = churn_month AND fixed_account = churn_account
),
rj AS (
  SELECT x_acct, x_month, max(CASE ctype WHEN '1. Fixed Voluntary Churner' THEN '1. Fixed Voluntary Rejoiner'
                                          WHEN '2. Fixed Involuntary Churner' THEN '2. Fixed Involuntary Rejoiner' END) AS rtype
  FROM (SELECT DISTINCT fixed_account AS x_acct, CAST(fixed_month + 7 AS DATE) AS x_month, fixed_churner_type AS ctype
        FROM t1 WHERE fixed_churner_type IS NOT NULL) x
  JOIN (SELECT DISTINCT act_acct_cd, month FROM rep
        WHERE mora_fix <= 4 OR (mora_fix IS NULL AND {wk('lst_pymt_dt')} = month)) a
    ON a.act_acct_cd = x_acct AND a.month = x_month
  GROUP BY x_acct, x_month
),
fixed_table AS (
  SELECT t1.*, rtype AS fixed_rejoiner_type,
    CASE WHEN fixed_churner_type = '2. Fixed Involuntary Churner' THEN invol_rgu_churn
         WHEN fixed_churner_type = '1. Fixed Voluntary Churner' THEN max_rgus_count
         WHEN main_movement = '03. Downsell' THEN b_num_rgus - e_num_rgus ELSE 0 END AS fixed_rgu_churn,
    CASE WHEN main_movement = '01. Same RGUs' AND e_bill_amt - b_bill_amt > 0 THEN '1. Up-spin'
         WHEN main_movement = '01. Same RGUs' AND e_bill_amt - b_bill_amt < 0 THEN '2. Down-spin'
         ELSE '3. No Spin' END AS spin_movement,
    coalesce(b_vo_nm, '-') || coalesce(b_tv_nm, '-') || coalesce(b_bb_nm, '-') AS b_plan,
    coalesce(e_vo_nm, '-') || coalesce(e_tv_nm, '-') || coalesce(e_bb_nm, '-') AS e_plan
  FROM t1 LEFT JOIN rj ON fixed_month = x_month AND fixed_account = x_acct
)
"""

FIXED_COLS = ("fixed_month, fixed_account, active_bom, active_eom, b_num_rgus, e_num_rgus, b_mix, e_mix, "
              "b_bundle_name, e_bundle_name, b_tech_flag, e_tech_flag, b_avg_mrc, e_avg_mrc, b_bill_amt, e_bill_amt, "
              "b_overdue, e_overdue, b_mora, e_mora, main_movement, dif_total_rgu, spin_movement, "
              "b_fixed_tenure_segment, e_fixed_tenure_segment, fixed_churner_type, invol_rgu_churn, max_rgus_count, "
              "churn_tenure_days, fixed_rejoiner_type, fixed_rgu_churn, b_plan, e_plan")

SQL: dict[str, str] = {}

SQL["fixed_movement_report"] = with_(SNAP, FEAT, BASE) + """
SELECT fixed_month, main_movement, count(*) AS n_rows, count(DISTINCT fixed_account) AS n_accounts,
       CAST(sum(active_bom) AS BIGINT) AS bom_accounts, CAST(sum(active_eom) AS BIGINT) AS eom_accounts,
       CAST(sum(coalesce(b_num_rgus, 0)) AS BIGINT) AS bom_rgus, CAST(sum(coalesce(e_num_rgus, 0)) AS BIGINT) AS eom_rgus
FROM base GROUP BY fixed_month, main_movement
"""

SQL["repair_overdue"] = with_(SNAP, FEAT) + """
SELECT act_acct_cd, dt, fi_outst_age, prev_mora, next_mora, mora_fix FROM rep
"""

SQL["fixed_table"] = with_(SNAP, FEAT, BASE, CHURN) + f"SELECT {FIXED_COLS} FROM fixed_table\n"

SQL["churn_counts"] = with_(SNAP, FEAT, BASE, CHURN) + """
SELECT fixed_month, fixed_churner_type, count(DISTINCT fixed_account) AS churners,
       CAST(sum(coalesce(fixed_rgu_churn, 0)) AS BIGINT) AS rgus_lost
FROM fixed_table WHERE fixed_churner_type IS NOT NULL GROUP BY fixed_month, fixed_churner_type
"""

# --- mobile register adapter, mobile table ----------------------------------
EMAIL = ("CASE WHEN user_id % 25 = 0 THEN 'NOTIENE@GMAIL.COM' "
         "ELSE 'user' || CAST(user_id // 3 AS VARCHAR) || '@mail.test' END")
LINE = "'8.' || lpad(CAST(user_id AS VARCHAR), 6, '0')"
PHONE = "'6' || lpad(CAST(user_id AS VARCHAR), 7, '0')"

MOBILE = f"""
reg_g AS (
  SELECT user_id, {wk('CAST(ts AS DATE)')} AS fecha_parque, count(*) AS _n, sum(value) AS _amt,
         max(value) AS _mx, min(CAST(ts AS DATE)) AS _first
  FROM events WHERE event_type = 'signup' GROUP BY ALL
),
reg AS (
  SELECT fecha_parque, CASE WHEN _copy = 1 THEN '' ELSE {LINE} END AS id_abonado,
    CASE WHEN _n >= 2 THEN CAST(user_id - user_id % 2 AS VARCHAR) ELSE '#N/D' END AS contrato,
    {PHONE} AS num_telefono, {EMAIL} AS nom_email,
    CASE WHEN _mx >= 300 THEN '#N/D' ELSE replace(CAST(round(_amt, 2) AS VARCHAR), '.', ',') END AS renta,
    CASE WHEN _mx < 10 THEN 'ARTICULO SIN EQUIPO'
         ELSE strftime(min(_first) OVER (PARTITION BY user_id), '%m/%d/%Y') END AS fch_activacion,
    CASE WHEN _amt > 500 THEN 'Empresas - Pymes' ELSE 'Residencial' END AS des_segmento_cliente
  FROM (SELECT *, unnest(CASE WHEN user_id % 7 = 0 THEN [0, 0] WHEN user_id % 13 = 0 THEN [0, 1, 1] ELSE [0] END) AS _copy
        FROM reg_g)
),
mclean AS (
  SELECT DISTINCT CAST(fecha_parque + 7 AS DATE) AS month, replace(id_abonado, '.', '') AS id_abonado,
    CASE WHEN contrato IN ('#N/D', 'nan', 'NULL', '') THEN NULL ELSE contrato END AS fixed_contract,
    num_telefono, nom_email,
    CASE WHEN renta LIKE '%#%' OR renta LIKE '%/%' OR renta LIKE 'NULL' THEN NULL
         ELSE TRY_CAST(replace(coalesce(renta, '0'), ',', '.') AS DOUBLE) END AS renta,
    CASE WHEN fch_activacion IN ('#N/D', 'SAMSUNG GALAXY A03 CORE 32GB NEGRO', 'IPHONE 12 PRO MAX GRAFITO 256GB',
                                 'ARTICULO SIN EQUIPO') THEN NULL
         ELSE CAST(try_strptime(substr(fch_activacion, 1, 10), '%m/%d/%Y') AS DATE) END AS start_date
  FROM reg WHERE des_segmento_cliente NOT IN ('Empresas - Empresas', 'Empresas - Pymes') AND id_abonado <> ''
),
mb AS (
  SELECT month AS bm, id_abonado AS bl, fixed_contract AS b_fixed_contract, renta AS b_mobile_mrc,
         num_telefono AS b_num_telefono, nom_email AS b_correo, start_date AS b_start_date FROM mclean
),
me AS (
  SELECT CAST(month - 7 AS DATE) AS em, id_abonado AS el, fixed_contract AS e_fixed_contract, renta AS e_mobile_mrc,
         num_telefono AS e_num_telefono, nom_email AS e_correo, start_date AS e_start_date FROM mclean
),
mbase0 AS (
  SELECT coalesce(bm, em) AS mobile_month, coalesce(bl, el) AS mobile_account,
         CASE WHEN bl IS NOT NULL THEN 1 ELSE 0 END AS mobile_active_bom,
         CASE WHEN el IS NOT NULL THEN 1 ELSE 0 END AS mobile_active_eom, mb.*, me.*,
         CAST(sign(date_diff('day', b_start_date, coalesce(bm, em))) * floor(abs(date_diff('day', b_start_date, coalesce(bm, em))) / 7) AS INTEGER) AS b_mobile_tenure,
         CAST(sign(date_diff('day', e_start_date, coalesce(bm, em))) * floor(abs(date_diff('day', e_start_date, coalesce(bm, em))) / 7) AS INTEGER) AS e_mobile_tenure
  FROM mb FULL OUTER JOIN me ON bl = el AND bm = em
),
mbase AS (
  SELECT *,
    CASE WHEN b_mobile_tenure < 6 THEN 'Early Tenure' WHEN b_mobile_tenure IS NOT NULL THEN 'Late Tenure' END AS b_mobile_tenure_segment,
    CASE WHEN e_mobile_tenure < 6 THEN 'Early Tenure' WHEN e_mobile_tenure IS NOT NULL THEN 'Late Tenure' END AS e_mobile_tenure_segment,
    coalesce(b_fixed_contract, e_fixed_contract, mobile_account) AS fmc_account,
    CASE
      WHEN mobile_active_bom = 1 AND mobile_active_eom = 1 AND b_mobile_mrc = e_mobile_mrc THEN '01.Maintain'
      WHEN mobile_active_bom = 1 AND mobile_active_eom = 1 AND b_mobile_mrc > e_mobile_mrc THEN '02.Downspin'
      WHEN mobile_active_bom = 1 AND mobile_active_eom = 1 AND b_mobile_mrc < e_mobile_mrc THEN '03.Upspin'
      WHEN mobile_active_bom = 1 AND mobile_active_eom = 0 THEN '04.Loss'
      WHEN mobile_active_bom = 0 AND mobile_active_eom = 1 AND {wk('e_start_date')} <> mobile_month THEN '05.Come Back To Life'
      WHEN mobile_active_bom = 0 AND mobile_active_eom = 1 AND {wk('e_start_date')} = mobile_month THEN '06.New Customer'
      WHEN b_mobile_mrc IS NULL OR e_mobile_mrc IS NULL THEN '07.MRC Gap'
    END AS mobile_movement_flag
  FROM mbase0
),
mv AS (
  SELECT user_id, {wk('CAST(ts AS DATE)')} AS dt, count(*) AS _n FROM events WHERE event_type = 'error' GROUP BY ALL
),
moves AS (
  SELECT {LINE} AS id_abonado,
    CASE _n WHEN 1 THEN 'BAJA VOLUNTARIA' WHEN 2 THEN 'BAJA INVOLUNTARIA' WHEN 3 THEN 'BAJA PORTABILIDAD'
            ELSE 'ALTA/MIGRACION' END AS tipo_baja, dt FROM mv
),
reasons AS (
  SELECT replace(id_abonado, '.', '') AS rl, {wk('dt')} AS rm,
    max(CASE WHEN tipo_baja IN ('ALTA/MIGRACION', 'BAJA INVOLUNTARIA', 'BAJA PORTABILIDAD') THEN '2. Mobile Involuntary Churner'
             WHEN tipo_baja = 'BAJA VOLUNTARIA' THEN '1. Mobile Voluntary Churner' END) AS rtype
  FROM moves GROUP BY ALL
),
mt1 AS (
  SELECT mbase.*, CASE WHEN mobile_active_bom = 1 AND mobile_active_eom = 0 THEN rtype END AS mobile_churn_type
  FROM mbase LEFT JOIN reasons ON mobile_account = rl AND mobile_month = rm
),
mt2 AS (
  SELECT *, coalesce(mobile_churn_type, '3. Mobile NonChurner') AS mobile_churn_flag,
         CASE WHEN mobile_churn_type IS NOT NULL THEN 1 ELSE 0 END AS mobile_rgu_churn FROM mt1
),
mrej AS (
  SELECT mobile_account AS ra, CAST(mobile_month + 7 AS DATE) AS rm2,
    max(CASE mobile_churn_type WHEN '1. Mobile Voluntary Churner' THEN '1. Mobile Voluntary Rejoiner'
             WHEN '2. Mobile Involuntary Churner' THEN '2. Mobile Involuntary Rejoiner' END) AS mobile_rejoiner_type
  FROM mt2 WHERE mobile_churn_type IS NOT NULL GROUP BY ALL
),
mobile_table AS (
  SELECT mt2.*, mobile_rejoiner_type FROM mt2 LEFT JOIN mrej ON mobile_account = ra AND mobile_month = rm2
)
"""

MOBILE_COLS = ("mobile_month, mobile_account, mobile_active_bom, mobile_active_eom, b_fixed_contract, e_fixed_contract, "
               "b_mobile_mrc, e_mobile_mrc, b_correo, b_start_date, e_start_date, b_mobile_tenure, e_mobile_tenure, "
               "b_mobile_tenure_segment, e_mobile_tenure_segment, fmc_account, mobile_movement_flag, "
               "mobile_churn_type, mobile_churn_flag, mobile_rgu_churn, mobile_rejoiner_type")

SQL["mobile_table"] = with_(MOBILE) + f"SELECT {MOBILE_COLS} FROM mobile_table\n"

SQL["missing_clients"] = with_(MOBILE) + """
SELECT b.month, count(*) AS missing_clients
FROM (SELECT DISTINCT fixed_contract AS client, month FROM mclean WHERE fixed_contract IS NOT NULL) b
WHERE NOT EXISTS (SELECT 1 FROM mclean e WHERE e.fixed_contract = b.client AND CAST(e.month - 7 AS DATE) = b.month)
GROUP BY b.month
"""


def _targets(offsets) -> str:
    return " UNION ALL ".join(f"SELECT xa, xm, xr, CAST(xm + {7 * k} AS DATE) AS p FROM ex" for k in offsets)


EXITS = """
ex AS (SELECT fixed_account AS xa, fixed_month AS xm, b_num_rgus AS xr FROM base WHERE active_bom = 1 AND active_eom = 0)
"""

SQL["rejoiner_window"] = with_(SNAP, FEAT, BASE, EXITS, f"""
rpop AS (SELECT DISTINCT xa, p FROM ({_targets([1, 0])}) t WHERE p <> xm)
""") + """
SELECT fixed_month,
  count(DISTINCT CASE WHEN xa IS NOT NULL THEN fixed_account END) AS rejoiner_population,
  count(DISTINCT CASE WHEN xa IS NOT NULL AND main_movement = '04. Come Back to Life' THEN fixed_account END) AS rejoiners
FROM base LEFT JOIN rpop ON fixed_account = xa AND fixed_month = p GROUP BY fixed_month
"""

POOL = f"""
pool AS (SELECT xa AS account, p AS month, max(xr) AS exit_rgus FROM ({_targets([0, 1, 2])}) t GROUP BY ALL)
"""

SQL["rejoiner_population"] = with_(SNAP, FEAT, BASE, EXITS, POOL) + """
SELECT month, count(*) AS pool_accounts, CAST(sum(coalesce(exit_rgus, 0)) AS BIGINT) AS pool_rgus FROM pool GROUP BY month
"""

SQL["effective_rejoiners"] = with_(SNAP, FEAT, BASE, EXITS, POOL, """
closing AS (SELECT fixed_account AS account, fixed_month AS month FROM base WHERE active_eom = 1)
""") + """
SELECT p.month, count(DISTINCT p.account) AS effective_rejoiners
FROM pool p JOIN closing c ON c.account = p.account AND c.month = p.month
WHERE NOT EXISTS (SELECT 1 FROM closing q WHERE q.account = p.account AND CAST(q.month + 7 AS DATE) = p.month)
GROUP BY p.month
"""

# --- convergence ------------------------------------------------------------
# Dummy addresses.
DUMMIES = ("'NOTIENE@GMAIL.COM', 'NorEPorTA@CABLETICA.COM', 'NorEPorTACorREO@CABLETICA.COM', "
           "'NorEPorTA.@CABLETICA.COM', 'NOTIENE@CABLETICA.COM', 'NA@GMAIL.COM', 'NOTIENE@NOTIENE.COM', "
           "'NorEPorTA@LIBERTY.COM', 'NO@GMAIL.COM'")

NEAR = f"""
fx_email AS (
  SELECT DISTINCT act_contact_mail_1 AS email, act_acct_cd AS contr FROM snap
  WHERE act_contact_mail_1 IS NOT NULL AND act_contact_mail_1 NOT IN ({DUMMIES})
),
near AS (
  SELECT DISTINCT replace(id_abonado, '.', '') AS near_line, fecha_parque AS near_file, email, contr
  FROM reg JOIN fx_email ON nom_email = email
  WHERE id_abonado <> '' AND des_segmento_cliente NOT IN ('Empresas - Empresas', 'Empresas - Pymes') AND nom_email NOT IN ({DUMMIES})
),
mnear AS (
  SELECT mobile_table.*, nb.email AS b_email, nb.contr AS b_contr, ne.email AS e_email, ne.contr AS e_contr
  FROM mobile_table
  LEFT JOIN near nb ON mobile_account = nb.near_line AND mobile_month = nb.near_file
  LEFT JOIN near ne ON mobile_account = ne.near_line AND mobile_month = CAST(ne.near_file - 7 AS DATE)
)
"""

FMC = """
fj AS (
  SELECT f.*, m.*,
    CASE WHEN fixed_account IS NOT NULL THEN fixed_month ELSE mobile_month END AS month,
    CASE WHEN fixed_account IS NOT NULL AND mobile_account IS NULL THEN fixed_account
         WHEN fixed_account IS NULL AND mobile_account IS NOT NULL THEN mobile_account
         WHEN fixed_account IS NOT NULL AND mobile_account IS NOT NULL THEN fixed_account || mobile_account END AS final_account,
    CASE WHEN active_bom = 1 OR mobile_active_bom = 1 THEN 1 ELSE 0 END AS final_bom_active_flag,
    CASE WHEN active_eom = 1 OR mobile_active_eom = 1 THEN 1 ELSE 0 END AS final_eom_active_flag
  FROM fixed_table f FULL OUTER JOIN mnear m
    ON right('0000000000' || fixed_account, 10) = right('0000000000' || fmc_account, 10) AND fixed_month = mobile_month
),
fs AS (
  SELECT *,
    CASE WHEN fixed_account IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY month, fixed_account) END AS contracts_fix,
    CASE
      WHEN fixed_account IS NOT NULL AND mobile_account IS NOT NULL AND active_bom = 1 AND mobile_active_bom = 1
           AND b_fixed_contract IS NOT NULL THEN 'Soft FMC'
      WHEN (b_email IS NOT NULL AND b_fixed_contract IS NULL AND active_bom = 1) OR (active_bom = 1 AND mobile_active_bom = 1) THEN 'Near FMC'
      WHEN fixed_account IS NOT NULL AND active_bom = 1 AND coalesce(mobile_active_bom, 0) = 0 THEN 'Fixed Only'
      WHEN mobile_account IS NOT NULL AND mobile_active_bom = 1 AND coalesce(active_bom, 0) = 0 THEN 'Mobile Only'
    END AS b_fmc_status,
    CASE
      WHEN fixed_account IS NOT NULL AND mobile_account IS NOT NULL AND active_eom = 1 AND mobile_active_eom = 1
           AND e_fixed_contract IS NOT NULL THEN 'Soft FMC'
      WHEN (e_email IS NOT NULL AND e_fixed_contract IS NULL AND active_eom = 1) OR (active_eom = 1 AND mobile_active_eom = 1) THEN 'Near FMC'
      WHEN fixed_account IS NOT NULL AND active_eom = 1 AND coalesce(mobile_active_eom, 0) = 0 THEN 'Fixed Only'
      WHEN mobile_account IS NOT NULL AND mobile_active_eom = 1 AND coalesce(active_eom, 0) = 0
           AND mobile_churn_type IS NULL THEN 'Mobile Only'
    END AS e_fmc_status
  FROM fj
),
ft AS (
  SELECT *,
    CASE
      WHEN b_fmc_status IN ('Fixed Only', 'Soft FMC', 'Near FMC') AND coalesce(mobile_active_bom, 0) = 0 AND b_mix = '1P' THEN 'Fixed 1P'
      WHEN b_fmc_status IN ('Fixed Only', 'Soft FMC', 'Near FMC') AND coalesce(mobile_active_bom, 0) = 0 AND b_mix = '2P' THEN 'Fixed 2P'
      WHEN b_fmc_status IN ('Fixed Only', 'Soft FMC', 'Near FMC') AND coalesce(mobile_active_bom, 0) = 0 AND b_mix = '3P' THEN 'Fixed 3P'
      WHEN b_fmc_status IN ('Soft FMC', 'Near FMC') AND coalesce(active_bom, 0) = 0 THEN 'Mobile Only'
      WHEN b_fmc_status = 'Mobile Only' THEN b_fmc_status
      WHEN b_fmc_status IN ('Near FMC', 'Soft FMC') THEN b_fmc_status
      WHEN final_bom_active_flag = 1 AND b_num_rgus = 0 THEN 'Fixed 0P'
    END AS b_fmc_type,
    CASE
      WHEN e_fmc_status = 'Fixed Only' AND fixed_churner_type IS NOT NULL THEN NULL
      WHEN e_fmc_status = 'Mobile Only' AND mobile_churn_type IS NOT NULL THEN NULL
      WHEN e_fmc_status = 'Fixed Only' AND (coalesce(mobile_active_eom, 0) = 0 OR (mobile_active_eom = 1 AND mobile_churn_type IS NOT NULL))
           AND e_mix = '1P' THEN 'Fixed 1P'
      WHEN e_fmc_status = 'Fixed Only' AND (coalesce(mobile_active_eom, 0) = 0 OR (mobile_active_eom = 1 AND mobile_churn_type IS NOT NULL))
           AND e_mix = '2P' THEN 'Fixed 2P'
      WHEN e_fmc_status = 'Fixed Only' AND (coalesce(mobile_active_eom, 0) = 0 OR (mobile_active_eom = 1 AND mobile_churn_type IS NOT NULL))
           AND e_mix = '3P' THEN 'Fixed 3P'
      WHEN (e_fmc_status IN ('Soft FMC', 'Near FMC', 'Mobile Only')
            AND (coalesce(active_eom, 0) = 0 OR (active_eom = 1 AND fixed_churner_type IS NOT NULL)))
           OR (e_fmc_status = 'Mobile Only' OR (coalesce(active_eom, 0) = 0 AND mobile_active_eom = 1)) THEN 'Mobile Only'
      WHEN e_fmc_status IN ('Soft FMC', 'Near FMC') AND fixed_churner_type IS NULL AND mobile_churn_type IS NULL
           AND active_eom = 1 AND mobile_active_eom = 1 THEN e_fmc_status
      WHEN final_eom_active_flag = 1 AND e_num_rgus = 0 THEN 'Fixed 0P'
    END AS e_fmc_type,
    CASE WHEN mobile_active_bom = 1 THEN 1 ELSE 0 END AS b_mobile_rgus,
    CASE WHEN mobile_active_eom = 1 THEN 1 ELSE 0 END AS e_mobile_rgus,
    CASE
      WHEN b_fmc_status = 'Fixed Only' OR (b_fmc_status IN ('Soft FMC', 'Near FMC') AND active_bom = 1 AND mobile_active_bom = 1) THEN b_tech_flag
      WHEN b_fmc_status = 'Mobile Only' OR (b_fmc_status IN ('Soft FMC', 'Near FMC', 'Undefined FMC') AND coalesce(active_bom, 0) = 0) THEN 'Wireless'
    END AS b_final_tech_flag,
    CASE
      WHEN (e_fmc_status = 'Fixed Only' AND fixed_churner_type IS NULL)
        OR (e_fmc_status IN ('Soft FMC', 'Near FMC') AND active_eom = 1 AND mobile_active_eom = 1 AND fixed_churner_type IS NULL) THEN e_tech_flag
      WHEN e_fmc_status = 'Mobile Only' OR (e_fmc_status IN ('Soft FMC', 'Near FMC') AND coalesce(active_eom, 0) = 0) THEN 'Wireless'
    END AS e_final_tech_flag,
    coalesce(b_fixed_tenure_segment, b_mobile_tenure_segment) AS b_tenure_final_flag,
    CASE WHEN e_fixed_tenure_segment IS NOT NULL AND fixed_churner_type IS NULL THEN e_fixed_tenure_segment
         WHEN e_mobile_tenure_segment IS NOT NULL AND mobile_churn_type IS NULL THEN e_mobile_tenure_segment END AS e_tenure_final_flag
  FROM fs
),
fg AS (
  SELECT *,
    CASE
      WHEN b_fmc_type IN ('Soft FMC', 'Near FMC') AND b_mix = '1P' THEN 'P2'
      WHEN b_fmc_type IN ('Soft FMC', 'Near FMC') AND b_mix = '2P' THEN 'P3'
      WHEN b_fmc_type IN ('Soft FMC', 'Near FMC') AND b_mix = '3P' THEN 'P4'
      WHEN b_fmc_type IN ('Soft FMC', 'Near FMC') AND b_mix = '0P' THEN 'P0'
      WHEN b_fmc_type IN ('Fixed 1P', 'Fixed 2P', 'Fixed 3P')
        OR (b_fmc_type IN ('Soft FMC', 'Near FMC') AND coalesce(mobile_active_bom, 0) = 0 AND active_bom = 1) THEN 'P1_Fixed'
      WHEN b_fmc_type = 'Mobile Only' OR (b_fmc_type = 'Soft FMC' AND coalesce(active_bom, 0) = 0 AND mobile_active_bom = 1) THEN 'P1_Mobile'
      WHEN b_fmc_type = 'Fixed 0P'
        OR (b_fmc_type IN ('Soft FMC', 'Near FMC') AND coalesce(mobile_active_bom, 0) = 0 AND active_bom = 1) THEN 'P0_Fixed'
    END AS b_fmc_segment,
    CASE
      WHEN e_fmc_type IN ('Soft FMC', 'Near FMC', 'Undefined FMC') AND active_eom = 1 AND mobile_active_eom = 1
           AND fixed_churner_type IS NULL AND mobile_churn_type IS NULL AND e_mix = '1P' THEN 'P2'
      WHEN e_fmc_type IN ('Soft FMC', 'Near FMC', 'Undefined FMC') AND active_eom = 1 AND mobile_active_eom = 1
           AND fixed_churner_type IS NULL AND mobile_churn_type IS NULL AND e_mix = '2P' THEN 'P3'
      WHEN e_fmc_type IN ('Soft FMC', 'Near FMC', 'Undefined FMC') AND active_eom = 1 AND mobile_active_eom = 1
           AND fixed_churner_type IS NULL AND mobile_churn_type IS NULL AND e_mix = '3P' THEN 'P4'
      WHEN (e_fmc_type IN ('Fixed 1P', 'Fixed 2P', 'Fixed 3P') OR (e_fmc_type IN ('Soft FMC', 'Near FMC') AND coalesce(mobile_active_eom, 0) = 0))
           AND active_eom = 1 AND fixed_churner_type IS NULL THEN 'P1_Fixed'
      WHEN (e_fmc_type = 'Mobile Only' OR (e_fmc_type = 'Soft FMC' AND coalesce(active_eom, 0) = 0))
           AND mobile_active_eom = 1 AND mobile_churn_type IS NULL THEN 'P1_Mobile'
      WHEN e_fmc_type = 'Fixed 0P' OR (e_fmc_type IN ('Soft FMC', 'Near FMC') AND coalesce(mobile_active_eom, 0) = 0 AND active_eom = 1) THEN 'P0_Fixed'
      WHEN e_fmc_type IN ('Soft FMC', 'Near FMC') AND e_mix = '0P' THEN 'P0'
    END AS e_fmc_segment,
    CASE
      WHEN (fixed_churner_type IS NOT NULL AND mobile_churn_type IS NOT NULL)
        OR (b_fmc_status = 'Fixed Only' AND fixed_churner_type IS NOT NULL)
        OR (b_fmc_status = 'Mobile Only' AND mobile_churn_type IS NOT NULL)
        OR (fixed_churner_type IS NULL AND active_bom = 1 AND mobile_active_bom = 1
            AND coalesce(active_eom, 0) = 0 AND coalesce(mobile_active_eom, 0) = 0) THEN 'Full Churner'
      WHEN fixed_churner_type IS NOT NULL AND mobile_churn_type IS NULL THEN 'Fixed Churner'
      WHEN fixed_churner_type IS NULL AND mobile_churn_type IS NOT NULL THEN 'Mobile Churner'
      WHEN (fixed_churner_type IS NOT NULL AND coalesce(active_bom, 0) = 0)
        OR (mobile_churn_type IS NOT NULL AND coalesce(mobile_active_bom, 0) = 0) THEN 'Previous churner'
      ELSE 'Non Churner'
    END AS final_churn_flag,
    coalesce(round(b_bill_amt, 0), 0.0) / contracts_fix + coalesce(round(b_mobile_mrc, 0), 0.0) AS b_total_mrc,
    coalesce(round(e_bill_amt, 0), 0.0) / contracts_fix + coalesce(round(e_mobile_mrc, 0), 0.0) AS e_total_mrc,
    (coalesce(b_num_rgus, 0) + b_mobile_rgus) / contracts_fix AS b_total_rgus,
    (coalesce(e_num_rgus, 0) + e_mobile_rgus) / contracts_fix AS e_total_rgus,
    coalesce(fixed_rgu_churn, 0) / contracts_fix + coalesce(mobile_rgu_churn, 0) AS total_rgu_churn,
    CASE
      WHEN (fixed_rejoiner_type IS NOT NULL AND mobile_rejoiner_type IS NOT NULL)
        OR ((fixed_rejoiner_type IS NOT NULL OR mobile_rejoiner_type IS NOT NULL) AND e_fmc_type IN ('Soft FMC', 'Near FMC')) THEN 'FMC Rejoiner'
      WHEN fixed_rejoiner_type IS NOT NULL THEN 'Fixed Rejoiner'
      WHEN mobile_rejoiner_type IS NOT NULL THEN 'Mobile Rejoiner'
    END AS rejoiner_final_flag
  FROM ft
),
fw AS (
  SELECT *, round(e_total_mrc, 0) - round(b_total_mrc, 0) AS mrc_change,
    CASE WHEN final_churn_flag = 'Full Churner' THEN 'Total Churner'
         WHEN final_churn_flag IN ('Fixed Churner', 'Mobile Churner') THEN 'Partial Churner'
         WHEN final_churn_flag = 'Previous churner' THEN 'Previous churner' END AS partial_total_churn_flag,
    CASE WHEN fixed_churner_type = '1. Fixed Voluntary Churner' THEN 'Voluntary'
         WHEN mobile_churn_type = '1. Mobile Voluntary Churner' THEN 'Voluntary'
         WHEN fixed_churner_type = '2. Fixed Involuntary Churner' THEN 'Involuntary'
         WHEN mobile_churn_type = '2. Mobile Involuntary Churner' THEN 'Involuntary'
         WHEN main_movement = '03. Downsell' THEN 'Voluntary' END AS churn_type_final_flag,
    CASE
      WHEN final_churn_flag <> 'Non Churner' THEN final_churn_flag
      WHEN b_total_rgus = e_total_rgus AND b_total_mrc = e_total_mrc THEN 'Maintain'
      WHEN b_total_rgus < e_total_rgus THEN 'Upsell'
      WHEN b_total_rgus > e_total_rgus THEN 'Downsell'
      WHEN b_total_rgus = e_total_rgus AND b_total_mrc < e_total_mrc THEN 'Upspin'
      WHEN b_total_rgus = e_total_rgus AND b_total_mrc > e_total_mrc THEN 'Downspin'
      WHEN b_fmc_type IN ('Fixed 1P', 'Fixed 2P', 'Fixed 3P', 'Fixed 0P', 'Mobile Only') AND e_fmc_type IN ('Soft FMC', 'Near FMC') THEN 'FMC Packing'
      WHEN final_bom_active_flag = 0 AND e_fmc_type IN ('Soft FMC', 'Near FMC') THEN 'FMC Gross Add'
      WHEN fixed_rejoiner_type IS NOT NULL AND mobile_rejoiner_type IS NOT NULL THEN 'FMC Rejoiner'
      WHEN fixed_rejoiner_type IS NOT NULL THEN 'Fixed Rejoiner'
      WHEN mobile_rejoiner_type IS NOT NULL THEN 'Mobile Rejoiner'
      WHEN main_movement IN ('04. Come Back to Life', '05. New Customer')
           AND mobile_movement_flag IN ('05.Come Back To Life', '06.New Customer') THEN 'FMC Gross Add'
      WHEN main_movement IN ('04. Come Back to Life', '05. New Customer') THEN 'Fixed Gross Add'
      WHEN mobile_movement_flag IN ('05.Come Back To Life', '06.New Customer') THEN 'Mobile Gross Add'
    END AS waterfall_flag,
    coalesce(b_plan, '') || coalesce(CAST(mobile_active_bom AS VARCHAR), '-') AS b_plan_full,
    coalesce(e_plan, '') || coalesce(CAST(mobile_active_eom AS VARCHAR), '-') AS e_plan_full
  FROM fg
),
fmc_table AS (
  SELECT *,
    CASE WHEN waterfall_flag = 'Downsell' AND main_movement = '03. Downsell' THEN 'Voluntary'
         WHEN waterfall_flag = 'Downsell' AND final_churn_flag <> 'Non Churner' THEN churn_type_final_flag
         WHEN waterfall_flag = 'Downsell' AND main_movement = '06. Loss' THEN 'Undefined' END AS downsell_split,
    CASE WHEN waterfall_flag = 'Downspin' THEN 'Voluntary' END AS downspin_split
  FROM fw
)
"""

FMC_COLS = ("month, final_account, fixed_account, mobile_account, final_bom_active_flag, final_eom_active_flag, "
            "b_fmc_status, e_fmc_status, contracts_fix, b_fmc_type, e_fmc_type, b_final_tech_flag, e_final_tech_flag, "
            "b_tenure_final_flag, e_tenure_final_flag, b_fmc_segment, e_fmc_segment, final_churn_flag, "
            "round(b_total_mrc, 4) AS b_total_mrc, round(e_total_mrc, 4) AS e_total_mrc, "
            "round(b_total_rgus, 4) AS b_total_rgus, round(e_total_rgus, 4) AS e_total_rgus, mrc_change, "
            "round(total_rgu_churn, 4) AS total_rgu_churn, rejoiner_final_flag, partial_total_churn_flag, "
            "churn_type_final_flag, waterfall_flag, b_plan_full, e_plan_full, downsell_split, downspin_split, "
            "b_email, b_contr")

FMC_ALL = (SNAP, FEAT, BASE, CHURN, MOBILE, NEAR, FMC)

SQL["fmc_table"] = with_(*FMC_ALL) + f"SELECT {FMC_COLS} FROM fmc_table\n"

# Dummy addresses of the dated match.
DUMMIES_DATED = "'NOTIENE@GMAIL.COM', 'NOREPORTA@CABLETICA.COM', 'NOREPORTACORREO@CABLETICA.COM'"

RESOLVED = f"""
nearday AS (
  SELECT DISTINCT replace(id_abonado, '.', '') AS near_line, fecha_parque AS near_file, nom_email AS email, act_acct_cd AS contr
  FROM reg JOIN snap ON nom_email = act_contact_mail_1 AND dt = fecha_parque
  WHERE id_abonado <> '' AND des_segmento_cliente NOT IN ('Empresas - Empresas', 'Empresas - Pymes')
    AND nom_email NOT IN ({DUMMIES_DATED})
),
adj AS (
  SELECT mobile_table.*, nb.email AS b_email, nb.contr AS b_contr, ne.email AS e_email, ne.contr AS e_contr,
    CASE WHEN b_fixed_contract IS NOT NULL THEN b_fixed_contract ELSE nb.contr END AS b_contract_adj,
    CASE WHEN e_fixed_contract IS NOT NULL THEN e_fixed_contract ELSE ne.contr END AS e_contract_adj
  FROM mobile_table
  LEFT JOIN nearday nb ON mobile_account = nb.near_line AND mobile_month = nb.near_file
  LEFT JOIN nearday ne ON mobile_account = ne.near_line AND mobile_month = CAST(ne.near_file - 7 AS DATE)
),
prel AS (SELECT *, CASE WHEN b_contract_adj IS NOT NULL THEN b_contract_adj ELSE e_contract_adj END AS contract_adj FROM adj),
accfix AS (SELECT contract_adj AS ca, mobile_month AS cm, count(*) AS fixed_count FROM prel GROUP BY ALL),
resolved AS (SELECT prel.*, fixed_count FROM prel LEFT JOIN accfix ON contract_adj = ca AND mobile_month = cm)
"""

SQL["email_match_dated"] = with_(SNAP, MOBILE, RESOLVED) + "SELECT near_line, near_file, email, contr FROM nearday\n"

SQL["contract_resolution"] = with_(SNAP, MOBILE, RESOLVED) + """
SELECT mobile_month, mobile_account, b_contr, e_contr, b_contract_adj, e_contract_adj, contract_adj, fixed_count FROM resolved
"""

SQL["fmc_base_resolved"] = with_(SNAP, FEAT, BASE, CHURN, MOBILE, RESOLVED, """
rsj AS (
  SELECT f.*, m.*, CASE WHEN fixed_account IS NOT NULL THEN fixed_month ELSE mobile_month END AS month,
    CASE WHEN fixed_account IS NOT NULL THEN fixed_account ELSE mobile_account END AS final_account,
    CASE WHEN active_bom = 1 OR mobile_active_bom = 1 THEN 1 ELSE 0 END AS final_bom_active_flag,
    CASE WHEN active_eom = 1 OR mobile_active_eom = 1 THEN 1 ELSE 0 END AS final_eom_active_flag,
    CASE WHEN fixed_count IS NULL THEN 1 ELSE fixed_count END AS contracts_fix
  FROM fixed_table f FULL OUTER JOIN resolved m ON fixed_account = contract_adj AND fixed_month = mobile_month
),
rsd AS (
  SELECT DISTINCT * EXCLUDE (b_email, e_email, b_contr, e_contr, b_contract_adj, e_contract_adj, contract_adj, fixed_count) FROM (
    SELECT *,
      CASE
        WHEN fixed_account IS NOT NULL AND mobile_account IS NOT NULL AND active_bom = 1 AND mobile_active_bom = 1
             AND b_fixed_contract IS NOT NULL THEN 'Soft FMC'
        WHEN (b_email IS NOT NULL AND b_fixed_contract IS NULL AND active_bom = 1) OR (active_bom = 1 AND mobile_active_bom = 1) THEN 'Near FMC'
        WHEN fixed_account IS NOT NULL AND active_bom = 1 AND coalesce(mobile_active_bom, 0) = 0 THEN 'Fixed Only'
        WHEN mobile_account IS NOT NULL AND mobile_active_bom = 1 AND coalesce(active_bom, 0) = 0 THEN 'Mobile Only'
      END AS b_fmc_status,
      CASE
        WHEN fixed_account IS NOT NULL AND mobile_account IS NOT NULL AND active_eom = 1 AND mobile_active_eom = 1
             AND e_fixed_contract IS NOT NULL THEN 'Soft FMC'
        WHEN (e_email IS NOT NULL AND e_fixed_contract IS NULL) OR (active_eom = 1 AND mobile_active_eom = 1) THEN 'Near FMC'
        WHEN fixed_account IS NOT NULL AND active_eom = 1 AND coalesce(mobile_active_eom, 0) = 0 THEN 'Fixed Only'
        WHEN mobile_account IS NOT NULL AND mobile_active_eom = 1 AND coalesce(active_eom, 0) = 0
             AND mobile_churn_type IS NULL THEN 'Mobile Only'
      END AS e_fmc_status,
      round(round(coalesce(b_bill_amt / contracts_fix, 0), 0) + coalesce(b_mobile_mrc, 0), 0) AS b_total_mrc,
      round(round(coalesce(e_bill_amt / contracts_fix, 0), 0) + coalesce(e_mobile_mrc, 0), 0) AS e_total_mrc
    FROM rsj))
""") + """
SELECT month, final_account, fixed_account, mobile_account, final_bom_active_flag, final_eom_active_flag,
       b_fmc_status, e_fmc_status, contracts_fix, b_total_mrc, e_total_mrc FROM rsd
"""

SQL["email_match"] = with_(SNAP, MOBILE, NEAR) + "SELECT near_line, near_file, email, contr FROM near\n"

SQL["fmc_grouped"] = with_(*FMC_ALL) + """
SELECT month, e_fmc_segment, e_fmc_type, e_final_tech_flag, waterfall_flag,
       count(DISTINCT final_account) AS accounts, count(DISTINCT fixed_account) AS fixed_accounts,
       count(DISTINCT mobile_account) AS mobile_accounts, CAST(sum(round(b_total_mrc, 0)) AS BIGINT) AS b_mrc,
       CAST(sum(round(e_total_mrc, 0)) AS BIGINT) AS e_mrc, round(sum(total_rgu_churn), 4) AS rgu_churn
FROM fmc_table GROUP BY ALL
"""

SQL["fmc_packing"] = with_(*FMC_ALL, """
pb AS (SELECT DISTINCT month, coalesce(fixed_account, fmc_account) AS acct FROM fmc_table WHERE b_fmc_type IN ('Soft FMC', 'Near FMC')),
pe AS (SELECT DISTINCT month, coalesce(fixed_account, fmc_account) AS acct FROM fmc_table WHERE e_fmc_type IN ('Soft FMC', 'Near FMC')),
pk AS (SELECT month, count(*) AS packing FROM pe WHERE NOT EXISTS (SELECT 1 FROM pb WHERE pb.month = pe.month AND pb.acct = pe.acct) GROUP BY month),
upk AS (SELECT month, count(*) AS unpacking FROM pb WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pb.month = pe.month AND pb.acct = pe.acct) GROUP BY month)
""") + """
SELECT m.month, CAST(coalesce(packing, 0) AS BIGINT) AS packing, CAST(coalesce(unpacking, 0) AS BIGINT) AS unpacking
FROM (SELECT DISTINCT month FROM fmc_table) m LEFT JOIN pk ON pk.month = m.month LEFT JOIN upk ON upk.month = m.month
"""

# --- drivers ---------------------------------------------------------------
def _sqlist(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


def _labels():
    from churnlens import labels as L
    return L


_L = _labels()

INTER = f"""
inter AS (
  SELECT account_id, account_type, event_id || CASE WHEN copy = 1 THEN 'v' ELSE '' END AS interaction_id,
    CASE WHEN copy = 1 THEN ts + INTERVAL 1 SECOND WHEN copy = 2 THEN ts + INTERVAL 1 DAY ELSE ts END AS interaction_start_time,
    interaction_purpose_descrip,
    CASE WHEN copy = 1 OR (value > 270 AND value <= 300) THEN 'CANCELADA' WHEN value > 300 THEN 'ANULADA' ELSE 'CERRADA' END
      AS interaction_status
  FROM (SELECT CAST(user_id AS VARCHAR) AS account_id, 'RESIDENCIAL' AS account_type, CAST(event_id AS VARCHAR) AS event_id, ts, value,
    CASE WHEN event_type = 'error' AND value < 50 THEN 'AVERIAS' WHEN event_type = 'error' THEN 'SIN SERVICIO INTERNET'
         WHEN event_type = 'click' THEN 'FACTURACION/COBROS' WHEN event_type = 'view' THEN 'CONSULTA GENERAL'
         WHEN event_type = 'purchase' THEN 'VENTANILLA' ELSE 'VENTAS' END AS interaction_purpose_descrip,
    unnest(CASE WHEN value BETWEEN 100 AND 120 THEN [0, 1] WHEN value > 120 AND value <= 140 THEN [0, 2] ELSE [0] END) AS copy
  FROM events)
),
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, CAST(interaction_start_time AS DATE), interaction_purpose_descrip
                                 ORDER BY interaction_start_time DESC, interaction_id DESC) AS rn
    FROM inter WHERE account_type IN ('RESIDENCIAL', 'PROGRAMA HOGARES CONECTADOS')) WHERE rn = 1
),
-- the driver table takes the latest of the interactions that are neither voided nor cancelled
vdedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, CAST(interaction_start_time AS DATE), interaction_purpose_descrip
                                 ORDER BY interaction_start_time DESC, interaction_id DESC) AS rn
    FROM inter WHERE account_type IN ('RESIDENCIAL', 'PROGRAMA HOGARES CONECTADOS')
      AND interaction_status NOT IN ('ANULADA', 'CANCELADA')) WHERE rn = 1
),
vcalls AS (SELECT * FROM vdedup WHERE interaction_purpose_descrip NOT IN ({_sqlist(_L.NON_CALL_PURPOSES)})),
vtickets AS (SELECT * FROM vdedup WHERE interaction_purpose_descrip IN ({_sqlist(_L.TECH_TICKET_PURPOSES)})),
calls AS (
  SELECT * FROM dedup WHERE interaction_status <> 'ANULADA'
    AND interaction_purpose_descrip NOT IN ({_sqlist(_L.NON_CALL_PURPOSES)})
),
tickets AS (
  SELECT * FROM dedup WHERE interaction_status <> 'ANULADA'
    AND interaction_purpose_descrip IN ({_sqlist(_L.TECH_TICKET_PURPOSES)})
)
"""

SORDERS = """
sorders AS (
  SELECT event_id AS order_id, CAST(user_id AS VARCHAR) AS account_name,
    CASE WHEN event_type = 'signup' THEN 'INSTALACION' ELSE 'DESINSTALACION' END AS order_type,
    CASE WHEN value >= 300 THEN 'CANCELADA' WHEN value >= 250 THEN 'ANULADA' ELSE 'FINALIZADA' END AS order_status,
    CASE WHEN event_type = 'signup' THEN NULL WHEN value >= 200 THEN 'MOROSIDAD' WHEN value >= 190 THEN NULL ELSE 'VOLUNTARIO' END AS order_reason,
    CAST(ts AS DATE) AS order_start_date,
    CAST(CAST(ts AS DATE) + CAST(floor(value) AS INTEGER) % 10 AS DATE) AS completed_date,
    ['TIENDA', 'TELEVENTAS', 'DIGITAL', 'PUERTA A PUERTA'][CAST(floor(value) AS INTEGER) % 4 + 1] AS channel_desc
  FROM events WHERE event_type = 'signup' OR (event_type = 'error' AND value >= 100)
)
"""

DRIVERS = f"""
starts AS (SELECT act_acct_cd AS account, min(dt) AS first_dna_date, max(act_cust_strt_dt) AS last_start FROM snap GROUP BY ALL),
f_early AS (
  SELECT DISTINCT account, {wk('first_dna_date')} AS month FROM vcalls c JOIN starts s ON s.account = c.account_id
  WHERE date_diff('day', last_start, CAST(interaction_start_time AS DATE)) <= 3
),
f_tech AS (
  SELECT DISTINCT account, {wk('first_dna_date')} AS month FROM vtickets c JOIN starts s ON s.account = c.account_id
  WHERE floor(date_diff('day', last_start, CAST(interaction_start_time AS DATE)) / 7) <= 1
     OR date_diff('day', last_start, CAST(interaction_start_time AS DATE)) < 0
),
f_long AS (
  SELECT DISTINCT account_name AS account, {wk('completed_date')} AS month FROM sorders
  WHERE order_type = 'INSTALACION' AND order_status = 'FINALIZADA' AND date_diff('day', order_start_date, completed_date) >= 6
),
act_snap AS (SELECT * FROM snap WHERE act_cust_typ IN ('RESIDENCIAL', 'PROGRAMA HOGARES CONECTADOS') AND act_acct_stat = 'ACTIVO'),
f_sales AS (
  SELECT DISTINCT i.act_acct_cd AS account, CASE WHEN inst >= {wk('f')} THEN inst ELSE {wk('f')} END AS month
  FROM (SELECT DISTINCT act_acct_cd, {wk('act_acct_inst_dt')} AS inst FROM act_snap) i
  JOIN (SELECT act_acct_cd, min(dt) AS f FROM act_snap GROUP BY ALL) m ON i.act_acct_cd = m.act_acct_cd
),
rep2 AS (
  SELECT *, CASE
      WHEN (fi_outst_age - pm > 2 AND fi_outst_age - nm > 2) OR (fi_outst_age - pm < -2 AND fi_outst_age - nm < -2) THEN pm + 1
      WHEN fi_outst_age IS NULL AND nm = pm + 2 THEN pm + 1
      ELSE fi_outst_age END AS mfix
  FROM (SELECT *, lag(fi_outst_age) OVER (PARTITION BY act_acct_cd ORDER BY dt) AS pm,
               lead(fi_outst_age) OVER (PARTITION BY act_acct_cd ORDER BY dt) AS nm FROM snap)
),
risk AS (
  SELECT r.act_acct_cd AS account, {wk('act_cust_strt_dt')} AS month, max(mfix) AS od
  FROM rep2 r JOIN (SELECT act_acct_cd, min(bill_dt_m0) AS fb FROM rep2 GROUP BY ALL) b ON r.act_acct_cd = b.act_acct_cd
  WHERE {wk('oldest_unpaid_bill_dt')} = {wk('fb')}
  GROUP BY ALL
),
f_claim AS (
  SELECT DISTINCT account_id AS account, {wk('CAST(interaction_start_time AS DATE)')} AS month FROM vdedup
  WHERE account_id IS NOT NULL AND interaction_status <> 'ANULADA'
    AND interaction_purpose_descrip IN ({_sqlist(_L.BILLING_PURPOSES)})
),
fd AS (SELECT act_acct_cd AS account, dt AS month, oldest_unpaid_bill_dt AS o, bill_dt_m0 FROM snap WHERE dt = {wk('dt')}),
f_mount AS (
  SELECT DISTINCT b.account, b.month FROM fd b JOIN fd a
    ON a.account = b.account AND CAST(a.month + 7 AS DATE) = b.month AND a.o = b.o
  WHERE b.bill_dt_m0 IS NOT NULL
),
dflags AS (
  SELECT account, month,
    max(CASE WHEN f = 'monthsale' THEN 1 ELSE 0 END) AS monthsale, max(CASE WHEN f = 'soft_dx' THEN 1 ELSE 0 END) AS soft_dx,
    max(CASE WHEN f = 'never_paid' THEN 1 ELSE 0 END) AS never_paid, max(CASE WHEN f = 'long_install' THEN 1 ELSE 0 END) AS long_install,
    max(CASE WHEN f = 'early_issue' THEN 1 ELSE 0 END) AS early_issue, max(CASE WHEN f = 'tech_call' THEN 1 ELSE 0 END) AS tech_call,
    max(CASE WHEN f = 'bill_claim' THEN 1 ELSE 0 END) AS bill_claim, max(CASE WHEN f = 'mounting_bill' THEN 1 ELSE 0 END) AS mounting_bill
  FROM (
    SELECT account, month, 'monthsale' AS f FROM f_sales
    UNION ALL SELECT account, month, 'soft_dx' FROM risk WHERE od >= 2
    UNION ALL SELECT account, month, 'never_paid' FROM risk WHERE od >= 4
    UNION ALL SELECT account, month, 'long_install' FROM f_long
    UNION ALL SELECT account, month, 'early_issue' FROM f_early
    UNION ALL SELECT account, month, 'tech_call' FROM f_tech
    UNION ALL SELECT account, month, 'bill_claim' FROM f_claim
    UNION ALL SELECT account, month, 'mounting_bill' FROM f_mount) u
  GROUP BY ALL
),
dmaster AS (
  SELECT t.*,
    CASE WHEN monthsale = 1 THEN fixed_account END AS monthsale_flag, CASE WHEN soft_dx = 1 THEN fixed_account END AS soft_dx_flag,
    CASE WHEN never_paid = 1 THEN fixed_account END AS never_paid_flag, CASE WHEN long_install = 1 THEN fixed_account END AS long_install_flag,
    CASE WHEN early_issue = 1 THEN fixed_account END AS early_issue_flag, CASE WHEN tech_call = 1 THEN fixed_account END AS tech_call_flag,
    CASE WHEN bill_claim = 1 THEN fixed_account END AS bill_claim_flag, CASE WHEN mounting_bill = 1 THEN fixed_account END AS mounting_bill_flag,
    CASE WHEN b_plan_full = e_plan_full THEN fixed_account END AS no_plan_change_flag,
    CASE WHEN abs(mrc_change) > b_total_mrc * 0.05 AND b_plan = e_plan AND b_plan_full = e_plan_full THEN fixed_account END AS increase_flag
  FROM fmc_table t LEFT JOIN dflags d ON t.fixed_account = d.account AND t.month = d.month
)
"""

_DFLAGS = ["monthsale_flag", "soft_dx_flag", "never_paid_flag", "long_install_flag", "early_issue_flag",
           "tech_call_flag", "bill_claim_flag", "mounting_bill_flag", "increase_flag", "no_plan_change_flag"]

SQL["driver_summary"] = with_(*FMC_ALL, INTER, SORDERS, DRIVERS, f"""
per_acct AS (
  SELECT month, fixed_account, {", ".join(f"max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS {c}" for c in _DFLAGS)}
  FROM dmaster WHERE final_churn_flag NOT IN ('Fixed Churner', 'Customer Gap', 'Full Churner', 'Churn Exception')
    AND fixed_account IS NOT NULL GROUP BY ALL
)""") + f"""
SELECT month, count(*) AS activebase, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _DFLAGS)}
FROM per_acct GROUP BY month
"""

CONTACTS = f"""
cw_all AS (SELECT DISTINCT account_id AS account, interaction_id, CAST(interaction_start_time AS DATE) AS d FROM dedup),
cw_last AS (SELECT account_id AS account, {wk('CAST(interaction_start_time AS DATE)')} AS month,
                   max(CAST(interaction_start_time AS DATE)) AS last_d FROM calls GROUP BY ALL),
call_n AS (SELECT l.account, l.month, count(DISTINCT interaction_id) AS n FROM cw_last l JOIN cw_all a
           ON a.account = l.account AND a.d BETWEEN CAST(l.last_d - 7 AS DATE) AND l.last_d GROUP BY ALL),
tk_all AS (SELECT DISTINCT account_id AS account, interaction_id, CAST(interaction_start_time AS DATE) AS d FROM tickets),
tk_last AS (SELECT account, {wk('d')} AS month, max(d) AS last_d FROM tk_all GROUP BY ALL),
tk_n AS (SELECT l.account, l.month, count(DISTINCT interaction_id) AS n FROM tk_last l JOIN tk_all a
         ON a.account = l.account AND a.d BETWEEN CAST(l.last_d - 7 AS DATE) AND l.last_d GROUP BY ALL),
failed AS (SELECT DISTINCT account_id AS account, {wk('CAST(interaction_start_time AS DATE)')} AS month FROM dedup
           WHERE interaction_status IN ('CANCELADA', 'ANULADA')),
dens AS (SELECT account_id AS account, {wk('CAST(interaction_start_time AS DATE)')} AS month,
                count(DISTINCT interaction_id) AS num_tech_tickets FROM dedup
         WHERE interaction_purpose_descrip IN ({_sqlist(_L.TECH_TICKET_PURPOSES)}) GROUP BY ALL),
cflags AS (
  SELECT account, month,
    max(CASE WHEN f = 'one_call' THEN 1 ELSE 0 END) AS one_call, max(CASE WHEN f = 'two_call' THEN 1 ELSE 0 END) AS two_call,
    max(CASE WHEN f = 'multiple_call' THEN 1 ELSE 0 END) AS multiple_call,
    max(CASE WHEN f = 'one_ticket' THEN 1 ELSE 0 END) AS one_ticket, max(CASE WHEN f = 'two_ticket' THEN 1 ELSE 0 END) AS two_ticket,
    max(CASE WHEN f = 'multiple_ticket' THEN 1 ELSE 0 END) AS multiple_ticket,
    max(CASE WHEN f = 'failed_visit' THEN 1 ELSE 0 END) AS failed_visit
  FROM (
    SELECT account, month, CASE WHEN n = 1 THEN 'one_call' WHEN n = 2 THEN 'two_call' ELSE 'multiple_call' END AS f FROM call_n
    UNION ALL SELECT account, month, CASE WHEN n = 1 THEN 'one_ticket' WHEN n = 2 THEN 'two_ticket' ELSE 'multiple_ticket' END FROM tk_n
    UNION ALL SELECT account, month, 'failed_visit' FROM failed) u
  GROUP BY ALL
),
cmaster AS (
  SELECT t.*, {", ".join(f"CASE WHEN {c} = 1 THEN fixed_account END AS {c}_flag" for c in
                          ["one_call", "two_call", "multiple_call", "one_ticket", "two_ticket", "multiple_ticket", "failed_visit"])},
         dens.num_tech_tickets
  FROM fmc_table t LEFT JOIN cflags c ON t.fixed_account = c.account AND t.month = c.month
  LEFT JOIN dens ON t.final_account = dens.account AND t.month = dens.month
)
"""

_CFLAGS = ["one_call_flag", "two_call_flag", "multiple_call_flag", "one_ticket_flag", "two_ticket_flag",
           "multiple_ticket_flag", "failed_visit_flag"]

SQL["contact_tiers"] = with_(*FMC_ALL, INTER, CONTACTS, f"""
per_acct AS (
  SELECT month, fixed_account, {", ".join(f"max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS {c}" for c in _CFLAGS)}
  FROM cmaster WHERE final_churn_flag NOT IN ('Fixed Churner', 'Customer Gap', 'Full Churner', 'Churn Exception')
    AND fixed_account IS NOT NULL GROUP BY ALL
),
s AS (SELECT month, count(*) AS activebase, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _CFLAGS)} FROM per_acct GROUP BY month),
d AS (SELECT month, CAST(sum(num_tech_tickets) AS BIGINT) AS ticket_density FROM cmaster
      WHERE final_churn_flag NOT IN ('Fixed Churner', 'Customer Gap', 'Full Churner', 'Churn Exception') GROUP BY month)
""") + "SELECT s.*, d.ticket_density FROM s LEFT JOIN d ON s.month = d.month\n"

# --- billing ----------------------------------------------------------------
OFP = f"""
fin AS (
  SELECT *, CAST(date_diff('day', oldest_unpaid_bill_final, dt) AS INTEGER) AS fi_outst_age_final FROM (
    SELECT snap.*, CASE WHEN {wk('lst_pymt_dt')} = {wk('dt')} THEN NULL
                        ELSE CAST({wk('lst_pymt_dt')} + 7 AS DATE) END AS oldest_unpaid_bill_final FROM snap)
)
"""

SQL["overdue_from_payment"] = with_(SNAP, OFP) + \
    "SELECT act_acct_cd, dt, oldest_unpaid_bill_final, fi_outst_age_final FROM fin\n"


def _funnel_sql(stages) -> str:
    ctes = [f"""cohort AS (SELECT DISTINCT act_acct_cd AS account, {wk('dt')} AS month FROM fin
                WHERE {wk('bill_dt_m0')} = {wk('dt')} AND (fi_outst_age_final = 0 OR fi_outst_age_final IS NULL))"""]
    joins, sel = [], []
    for name, lo, hi, col, back in stages:
        cond = f"{col} >= {lo}" if hi is None else f"{col} BETWEEN {lo} AND {hi}"
        ctes.append(f"s_{name} AS (SELECT DISTINCT act_acct_cd AS account, CAST({wk('dt')} - {7 * back} AS DATE) AS month "
                    f"FROM fin WHERE {cond})")
        joins.append(f"LEFT JOIN s_{name} ON s_{name}.account = c.account AND s_{name}.month = c.month")
        sel.append(f"count(s_{name}.account) AS {name}")
    return with_(SNAP, OFP, *ctes) + f"SELECT c.month, count(*) AS billed, {', '.join(sel)} FROM cohort c " \
        + " ".join(joins) + " GROUP BY c.month\n"


FUNNEL_STAGES = (("overdue", 2, None, "fi_outst_age_final", 0), ("soft_dx", 3, None, "fi_outst_age_final", 0),
                 ("hard_dx", 4, None, "fi_outst_age_final", 1))
SQL["debt_funnel"] = _funnel_sql(FUNNEL_STAGES)
SQL["debt_funnel_bands"] = with_(SNAP, OFP, f"""
bnd AS (SELECT DISTINCT act_acct_cd AS a, {wk('dt')} AS m FROM fin),
bil AS (SELECT DISTINCT act_acct_cd AS a, {wk('bill_dt_m0')} AS m FROM fin
        WHERE bill_dt_m0 IS NOT NULL AND (fi_outst_age_final <= 6 OR fi_outst_age_final IS NULL)),
st1 AS (SELECT DISTINCT act_acct_cd AS a, {wk('dt')} AS m FROM fin WHERE fi_outst_age_final BETWEEN 1 AND 2),
st2 AS (SELECT DISTINCT act_acct_cd AS a, {wk('dt')} AS m FROM fin WHERE fi_outst_age_final BETWEEN 3 AND 3),
st3 AS (SELECT DISTINCT act_acct_cd AS a, {wk('dt')} AS m FROM fin WHERE fi_outst_age_final >= 2 AND fi_outst_age <= 5),
st4 AS (SELECT DISTINCT act_acct_cd AS a, {wk('dt')} AS m FROM fin WHERE fi_outst_age BETWEEN 6 AND 7)
""") + """
SELECT bnd.m AS month, CAST(st1.a IS NOT NULL AS INTEGER) AS day_one, CAST(st2.a IS NOT NULL AS INTEGER) AS soft_dx,
       CAST(st3.a IS NOT NULL AS INTEGER) AS backlog, CAST(st4.a IS NOT NULL AS INTEGER) AS hard_dx,
       count(DISTINCT bnd.a) AS accounts, count(DISTINCT bil.a) AS billed
FROM bnd LEFT JOIN bil ON bil.a = bnd.a AND bil.m = bnd.m LEFT JOIN st1 ON st1.a = bnd.a AND st1.m = bnd.m
  LEFT JOIN st2 ON st2.a = bnd.a AND st2.m = bnd.m LEFT JOIN st3 ON st3.a = bnd.a AND st3.m = bnd.m
  LEFT JOIN st4 ON st4.a = bnd.a AND st4.m = bnd.m
GROUP BY ALL
"""

SQL["retention_funnel"] = with_(*FMC_ALL, f"""
rtreq AS (SELECT CAST(user_id AS VARCHAR) AS contrato, CAST(ts AS DATE) AS request_date,
               CASE WHEN value >= 100 THEN 'CONTACTO EFECTIVO' ELSE 'NO CONTACTADO' END AS contactabilidad,
               CASE WHEN value >= 200 THEN 'RETENIDO' ELSE 'NO RETENIDO' END AS solucion
        FROM events WHERE event_type = 'error'),
rtper AS (SELECT contrato AS account, {wk('request_date')} AS month,
                max(CASE WHEN contactabilidad = 'CONTACTO EFECTIVO' THEN 1 ELSE 0 END) AS loc,
                max(CASE WHEN solucion = 'RETENIDO' THEN 1 ELSE 0 END) AS ret FROM rtreq GROUP BY ALL),
rtj AS (SELECT m.month, loc, ret, rgus FROM (SELECT month, right('0000000000' || fixed_account, 10) AS pk,
           sum(coalesce(b_total_rgus, 0.0)) AS rgus FROM fmc_table WHERE fixed_account IS NOT NULL GROUP BY ALL) m
       JOIN rtper ON right('0000000000' || rtper.account, 10) = m.pk AND rtper.month = m.month)
""") + """
SELECT month, count(*) AS requests, CAST(sum(loc) AS BIGINT) AS located, CAST(sum(ret) AS BIGINT) AS retained,
       round(sum(rgus), 4) AS request_rgus, round(sum(rgus * loc), 4) AS located_rgus,
       round(sum(rgus * ret), 4) AS retained_rgus
FROM rtj GROUP BY month
"""

BILLS = """
bills AS (SELECT CAST(o_custkey AS VARCHAR) AS contrato, CAST(o_orderkey AS VARCHAR) AS factura,
                 CAST(o_orderdate AS DATE) AS fecha_fact, round(o_totalprice, 2) AS monto_fact FROM orders),
moves AS (SELECT CAST(l_orderkey AS VARCHAR) AS fact_aplica, CAST(l_shipdate AS DATE) AS fecha_mov,
                 CAST(round(CAST(l_extendedprice AS DECIMAL(9, 2)) * (1 - CAST(l_discount AS DECIMAL(3, 2)))
                       * (1 + CAST(l_tax AS DECIMAL(3, 2))), 2) AS DOUBLE) AS monto_mov FROM lineitem),
pay AS (SELECT fact_aplica AS factura, min(fecha_mov) AS first_payment FROM moves GROUP BY ALL),
bp AS (
  SELECT contrato, month, factura AS first_bill, fecha_fact AS bill_date, first_payment FROM (
    SELECT b.*, p.first_payment AS first_payment, CAST(date_trunc('month', fecha_fact) AS DATE) AS month,
           row_number() OVER (PARTITION BY b.contrato, date_trunc('month', b.fecha_fact) ORDER BY b.fecha_fact, right('0000000000' || b.factura, 10)) AS rn
    FROM bills b LEFT JOIN pay p ON b.factura = p.factura) WHERE rn = 1
)
"""

SQL["bill_payments"] = with_(BILLS) + "SELECT contrato, month, first_bill, bill_date, first_payment FROM bp\n"

CYCLE = """
cyc AS (SELECT o_custkey, o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_custkey % 28 AS INTEGER) AS d FROM orders),
cbills AS (SELECT DISTINCT d AS fechafactura, CAST(o_custkey AS VARCHAR) AS contrato,
                  right('0000000000' || CAST(o_orderkey AS VARCHAR), 10) AS factura FROM cyc),
cmoves AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS fact_aplica, min(d + CAST(o_orderkey * 7 % 80 AS INTEGER)) AS fechapago
           FROM cyc WHERE o_orderkey % 5 <> 0 GROUP BY ALL),
crm AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS acct, d + n AS dt FROM cyc, unnest([-2, 0, 9, 24, 40, 65]) t(n)),
firstbill AS (SELECT contrato, CAST(date_trunc('month', fechafactura) AS DATE) AS mesfactura, arg_min(factura, (fechafactura, factura)) AS pf
              FROM cbills GROUP BY ALL),
complete AS (SELECT fb.*, fechafactura, fechapago FROM firstbill fb JOIN cbills ON pf = factura LEFT JOIN cmoves ON pf = fact_aplica)
"""

SQL["oldest_unpaid_bill"] = with_(CYCLE, """
cur AS (SELECT crm.*, t.fechafactura AS bill, t.fechapago AS bill_pay FROM crm LEFT JOIN complete t
        ON t.contrato = acct AND date_trunc('month', t.fechafactura) = date_trunc('month', dt)),
prv AS (SELECT cur.*, t.fechafactura AS prev_bill, t.fechapago AS prev_pay FROM cur LEFT JOIN complete t
        ON t.contrato = acct AND bill = CAST(t.fechafactura + INTERVAL 1 MONTH AS DATE)),
nopay AS (SELECT contrato, min(fechafactura) AS no_pay FROM complete WHERE fechapago IS NULL GROUP BY ALL),
paidb AS (SELECT DISTINCT contrato,
    first_value(mesfactura) OVER (PARTITION BY contrato ORDER BY fechapago, mesfactura) AS m_first,
    first_value(fechapago) OVER (PARTITION BY contrato ORDER BY fechapago, mesfactura) AS p_first,
    first_value(mesfactura) OVER (PARTITION BY contrato ORDER BY fechapago DESC, mesfactura DESC) AS m_last,
    first_value(fechapago) OVER (PARTITION BY contrato ORDER BY fechapago DESC, mesfactura DESC) AS p_last
  FROM complete WHERE fechapago IS NOT NULL),
stepone AS (SELECT prv.*, CASE
    WHEN dt < p_first AND dt >= m_first THEN m_first
    WHEN dt >= bill_pay THEN NULL
    WHEN bill_pay > dt AND prev_pay IS NULL AND prev_bill IS NULL AND dt >= bill THEN bill
    WHEN dt < bill_pay AND dt < prev_pay AND dt >= prev_bill THEN prev_bill
    WHEN dt >= prev_pay AND dt <= bill_pay AND dt >= bill THEN bill
    WHEN bill_pay IS NULL AND prev_pay IS NOT NULL AND dt < prev_pay AND dt >= prev_bill THEN prev_bill
    WHEN bill IS NOT NULL AND dt >= no_pay THEN no_pay
    WHEN dt < p_last AND dt >= m_last THEN m_last
    ELSE NULL END AS oldest
  FROM prv LEFT JOIN nopay ON nopay.contrato = acct LEFT JOIN paidb ON paidb.contrato = acct)
""") + """
SELECT acct AS contrato, dt AS day, bill AS current_bill, oldest AS oldest_unpaid_bill,
       CAST(date_diff('day', oldest, dt) AS INTEGER) AS overdue_days FROM stepone
"""

SQL["payment_sources"] = with_(CYCLE, """
pmt AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS doc,
          CASE WHEN o_orderkey % 11 = 0 THEN '-1' ELSE CAST(o_orderkey AS VARCHAR) END AS invoice_id,
          CASE WHEN o_orderkey % 4 = 0 AND k = 1 THEN 1.0 ELSE floor(o_totalprice * 50) / 100 END AS amt
        FROM orders, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [0, 1, 1] ELSE [0, 1] END) t(k)),
upay AS (SELECT right('0000000000' || invoice_id, 10) AS invoice, round(sum(amt), 2) AS payment_total FROM pmt
         WHERE invoice_id <> '-1' GROUP BY ALL),
umov AS (SELECT lpad(CAST(c.o_orderkey AS VARCHAR), 10, '0') AS invoice, min(d + CAST(c.o_orderkey * 7 % 80 AS INTEGER)) AS first_movement,
                round(sum(round(o_totalprice, 2)), 0) AS movement_total
         FROM cyc c JOIN orders o ON o.o_orderkey = c.o_orderkey WHERE c.o_orderkey % 5 <> 0 GROUP BY ALL)
""") + """
SELECT upay.invoice, payment_total, contrato, mesfactura AS month, fechafactura AS bill_date, first_movement, movement_total,
       round(payment_total - movement_total, 2) AS difference
FROM upay JOIN complete ON pf = upay.invoice JOIN umov ON umov.invoice = upay.invoice
"""

SQL["payment_reconciliation"] = with_(BILLS) + """
SELECT b.factura, b.monto_fact AS billed, p.paid, round(b.monto_fact - p.paid, 2) AS difference
FROM bills b JOIN (SELECT fact_aplica AS factura, round(sum(monto_mov), 2) AS paid FROM moves GROUP BY ALL) p
  ON b.factura = p.factura
"""

# --- quality ----------------------------------------------------------------
SQL["all_null_accounts"] = with_(SNAP) + f"""
SELECT {wk('dt')} AS month, act_acct_cd AS account, count(*) AS days FROM snap
WHERE coalesce(fi_vo_mrc_amt, 0.0) + coalesce(fi_tv_mrc_amt, 0.0) + coalesce(fi_bb_mrc_amt, 0.0) = 0
GROUP BY ALL HAVING count(*) = 7
"""

SQL["intermittent_products"] = with_(SNAP) + f"""
SELECT month, count(*) AS intermittent_accounts FROM (
  SELECT act_acct_cd, {wk('dt')} AS month,
    max(CASE WHEN coalesce(pd_vo_prod_nm, '') <> '' OR coalesce(pd_tv_prod_nm, '') <> '' OR coalesce(pd_bb_prod_nm, '') <> ''
             THEN 1 ELSE 0 END) AS w,
    max(CASE WHEN dt <> {wk('dt')} THEN NULL
             WHEN coalesce(pd_vo_prod_nm, '') <> '' OR coalesce(pd_tv_prod_nm, '') <> '' OR coalesce(pd_bb_prod_nm, '') <> ''
             THEN 1 ELSE 0 END) AS opening
  FROM snap GROUP BY ALL) WHERE w = 1 AND opening = 0 GROUP BY month
"""

SQL["overdue_histogram"] = with_(SNAP, FEAT) + """
SELECT month, mora_fix, count(DISTINCT act_acct_cd) AS accounts FROM rep GROUP BY ALL
"""

# --- KPIs -------------------------------------------------------------------
FTR = f"""
bill AS (SELECT DISTINCT account_id AS account, CAST(interaction_start_time AS DATE) AS day, interaction_id AS id FROM inter
         WHERE account_id IS NOT NULL AND interaction_status <> 'ANULADA'
           AND interaction_purpose_descrip IN ({_sqlist(_L.BILLING_PURPOSES)})),
unsolved AS (SELECT DISTINCT a.account, a.day, a.id FROM bill a JOIN bill b ON a.account = b.account AND a.id <> b.id
             AND date_diff('day', a.day, b.day) BETWEEN 0 AND 2),
repeated AS (SELECT account, day, max(id) AS id FROM unsolved GROUP BY ALL),
solved AS (SELECT a.account, a.day, max(a.id) AS id FROM bill a LEFT JOIN repeated r ON r.account = a.account AND r.id = a.id
           AND r.day = a.day WHERE r.id IS NULL GROUP BY ALL),
all_bill AS (SELECT account, {wk('day')} AS month, count(DISTINCT id) AS billing_calls FROM bill GROUP BY ALL),
ftr AS (SELECT b.account, b.month, coalesce(s.resolved, 0) AS resolved, b.billing_calls FROM all_bill b LEFT JOIN
        (SELECT account, {wk('day')} AS month, count(DISTINCT id) AS resolved FROM solved GROUP BY ALL) s
        ON s.account = b.account AND s.month = b.month)
"""

SQL["first_time_resolution"] = with_(INTER, FTR) + "SELECT account, month, resolved, billing_calls FROM ftr\n"

KPI = f"""
km AS (SELECT *, CASE WHEN abs(mrc_change) > b_total_mrc * 0.05 AND b_plan = e_plan AND b_plan_full = e_plan_full THEN fixed_account END
         AS increase_flag, right('0000000000' || fixed_account, 10) AS pk FROM fmc_table),
rg AS (SELECT month, CAST(sum(b_num_rgus) AS DOUBLE) AS rgus FROM km GROUP BY ALL),
an AS (SELECT right('0000000000' || account_id, 10) AS pk, {wk('CAST(interaction_start_time AS DATE)')} AS month,
         count(DISTINCT CASE WHEN interaction_purpose_descrip IN ({_sqlist(_L.TECH_TICKET_PURPOSES)}) THEN interaction_id END) AS tickets,
         count(DISTINCT CASE WHEN interaction_purpose_descrip NOT IN ({_sqlist(_L.NON_CALL_PURPOSES)}) THEN interaction_id END) AS calls,
         count(DISTINCT CASE WHEN interaction_purpose_descrip IN ({_sqlist(_L.BILLING_PURPOSES)}) THEN interaction_id END) AS billing
       FROM inter WHERE interaction_status <> 'ANULADA' GROUP BY ALL),
kc AS (SELECT km.month, round(sum(nullif(tickets, 0) / contracts_fix), 4) AS tickets, round(sum(nullif(calls, 0) / contracts_fix), 4) AS calls
       FROM km LEFT JOIN an ON an.pk = km.pk AND an.month = km.month GROUP BY ALL),
cpv AS (SELECT km.month, CAST(sum(nullif(billing, 0)) AS BIGINT) AS calls, count(DISTINCT increase_flag) AS variations
        FROM km LEFT JOIN an ON an.pk = km.pk AND an.month = km.month WHERE increase_flag IS NOT NULL GROUP BY ALL),
fp AS (SELECT km.month, round(sum(resolved / contracts_fix), 4) AS resolved, sum(round(billing_calls / contracts_fix, 0)) AS billing_calls
       FROM km LEFT JOIN ftr ON right('0000000000' || ftr.account, 10) = km.pk AND ftr.month = km.month GROUP BY ALL),
p1 AS (SELECT kc.month, 'TEST' AS market, 'tech_tickets_per_1k_rgu' AS kpi_name, round(tickets * 1000.0 / NULLIF(rgus, 0), 4) AS measure,
              CAST(tickets AS DOUBLE) AS numerator, CAST(rgus AS DOUBLE) AS denominator, 'M-0' AS kpi_delay FROM kc JOIN rg ON kc.month = rg.month),
p2 AS (SELECT kc.month, 'TEST', 'care_calls_per_1k_rgu', round(calls * 1000.0 / NULLIF(rgus, 0), 4),
              CAST(calls AS DOUBLE), CAST(rgus AS DOUBLE), 'M-0' FROM kc JOIN rg ON kc.month = rg.month),
p3 AS (SELECT month, 'TEST', 'billing_calls_per_bill_variation', round(CAST(calls AS DOUBLE) / NULLIF(variations, 0), 4),
              CAST(calls AS DOUBLE), CAST(variations AS DOUBLE), 'M-0' FROM cpv),
p4 AS (SELECT month, 'TEST' AS market, 'first_time_resolution' AS kpi_name, round(CAST(resolved AS DOUBLE) / NULLIF(billing_calls, 0), 4) AS measure,
              CAST(resolved AS DOUBLE) AS numerator, CAST(billing_calls AS DOUBLE) AS denominator, 'M-0' AS kpi_delay FROM fp),
p5 AS (SELECT CAST(month + 7 AS DATE), market, kpi_name, measure, numerator, denominator, 'M-1' FROM p4),
months AS (SELECT month FROM p1 UNION SELECT month FROM p4),
p6 AS (SELECT month, 'TEST', n, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'M-0'
       FROM months, (SELECT unnest(['nps_detractors', 'digital_payment_share']) AS n)),
kpi_rows AS (SELECT * FROM p1 UNION SELECT * FROM p2 UNION SELECT * FROM p3 UNION SELECT * FROM p4
             UNION SELECT * FROM p5 UNION SELECT * FROM p6)
"""

SQL["kpi_table"] = with_(*FMC_ALL, INTER, FTR, KPI) + "SELECT * FROM kpi_rows\n"

SQL["kpi_overall"] = with_(*FMC_ALL, INTER, FTR, KPI) + """
SELECT month, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month_num, kpi_name,
  round(CASE WHEN count(numerator) = 0 AND count(denominator) = 0 THEN sum(measure)
             WHEN count(numerator) > 0 AND count(denominator) > 0 THEN sum(numerator) / NULLIF(sum(denominator), 0) END, 4) AS overall
FROM kpi_rows GROUP BY month, kpi_name
"""

# --- churn by service orders, gross adds, user base -------------------------
UNINST = """
u AS (SELECT * FROM sorders WHERE order_type = 'DESINSTALACION' AND order_status IS NOT NULL)
"""

SQL["churn_by_order"] = with_(SNAP, SORDERS, UNINST, """
lo AS (SELECT account_name, order_start_date AS d, order_reason AS r FROM (
         SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY order_start_date DESC, order_id DESC) AS rn FROM u)
       WHERE rn = 1),
ls AS (SELECT act_acct_cd, max(dt) AS last_snapshot FROM snap GROUP BY ALL)
""") + f"""
SELECT account_name AS account, {wk('d')} AS churn_month,
       CASE WHEN r = 'MOROSIDAD' THEN '2. Fixed Involuntary Churner' ELSE '1. Fixed Voluntary Churner' END AS churn_type
FROM lo JOIN ls ON act_acct_cd = account_name
WHERE floor(date_diff('day', {wk('d')}, {wk('last_snapshot')}) / 7) <= 1 AND r IS NOT NULL
"""

SQL["churn_by_first_order"] = with_(SORDERS, UNINST) + f"""
SELECT account_name AS account, {wk('order_start_date')} AS first_order_month,
       CASE WHEN order_reason = 'MOROSIDAD' THEN '2. Fixed Involuntary Churner' WHEN order_reason IS NOT NULL THEN '1. Fixed Voluntary Churner' END AS churn_type
FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY order_start_date, order_id) AS rn FROM u) WHERE rn = 1
"""

SQL["gross_adds"] = with_(SNAP, f"""
uf AS (SELECT act_acct_cd, dt, act_cust_strt_dt, pd_vo_prod_nm AS vo, pd_bb_prod_nm AS bb, pd_tv_prod_nm AS tv,
              avg(fi_vo_mrc_amt) AS avgvo, avg(fi_bb_mrc_amt) AS avgbb, avg(fi_tv_mrc_amt) AS avgtv
       FROM snap WHERE (pd_vo_prod_nm <> '' OR pd_bb_prod_nm <> '' OR pd_tv_prod_nm <> '')
         AND (fi_outst_age <= 90 OR fi_outst_age IS NULL) GROUP BY ALL),
gam AS (SELECT act_acct_cd, min(act_cust_strt_dt) AS fs, {wk('dt')} AS month, vo, bb, tv, avgvo, avgbb, avgtv
        FROM uf WHERE dt = {wk('dt')} + 6 GROUP BY ALL HAVING min(act_cust_strt_dt) >= {wk('dt')})
""") + """
SELECT month, count(*) AS gross_adds, CAST(sum(CASE WHEN vo <> '' THEN 1 ELSE 0 END) AS BIGINT) AS gross_adds_vo,
       CAST(sum(CASE WHEN bb <> '' THEN 1 ELSE 0 END) AS BIGINT) AS gross_adds_bb,
       CAST(sum(CASE WHEN tv <> '' THEN 1 ELSE 0 END) AS BIGINT) AS gross_adds_tv,
       round(sum(avgvo), 0) AS revenue_vo, round(sum(avgbb), 0) AS revenue_bb, round(sum(avgtv), 0) AS revenue_tv
FROM gam GROUP BY month
"""

EARLY = f"""
inst AS (SELECT DISTINCT act_acct_cd AS account, act_acct_inst_dt AS start FROM snap),
cday AS (SELECT account_id AS account, CAST(interaction_start_time AS DATE) AS day, count(DISTINCT interaction_id) AS n FROM inter
         WHERE interaction_status <> 'ANULADA' AND interaction_purpose_descrip NOT IN ({_sqlist(_L.NON_CALL_PURPOSES)}) GROUP BY ALL),
latest AS (SELECT c.account, day, n, max(start) AS start FROM cday c JOIN inst i ON i.account = c.account AND i.start <= c.day GROUP BY ALL)
"""
_EARLY_SUMS = f"""CAST(coalesce(sum(CASE WHEN date_diff('day', s.start, day) BETWEEN 0 AND 2 THEN n END), 0) AS BIGINT) AS calls_early,
  CAST(coalesce(sum(CASE WHEN date_diff('day', s.start, day) BETWEEN 0 AND 9 THEN n END), 0) AS BIGINT) AS calls_late,
  CAST(coalesce(sum(CASE WHEN date_diff('day', {wk('s.start')}, {wk('day')}) BETWEEN 7 AND 21 THEN n END), 0) AS BIGINT) AS calls_periods_1_3"""

SQL["early_contacts_by_start"] = with_(SNAP, INTER, EARLY) + f"""
SELECT s.account, s.start, {wk('s.start')} AS month, {_EARLY_SUMS}
FROM inst s LEFT JOIN latest a ON a.account = s.account AND a.start = s.start GROUP BY s.account, s.start
"""

SQL["early_contacts_by_event"] = with_(SNAP, INTER, EARLY) + f"""
SELECT s.account, s.start, {wk('day')} AS month, {_EARLY_SUMS} FROM latest s GROUP BY s.account, s.start, {wk('day')}
"""

TICKETS = """
register AS (
  SELECT 'T' || event_id AS ticket_number,
    CASE WHEN user_id % 5 = 0 THEN substr(lpad(CAST(user_id AS VARCHAR), 12, '0'), 1, 4) || '-' || substr(lpad(CAST(user_id AS VARCHAR), 12, '0'), 5, 8)
         WHEN user_id % 5 = 1 THEN lpad(CAST(user_id AS VARCHAR), 10, '0') ELSE 'A' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS account_id,
    CASE WHEN user_id % 7 = 0 THEN 'Business' WHEN user_id % 2 = 0 THEN 'RESIDENTIAL' ELSE 'Residential HFC' END AS cust_type,
    CASE WHEN value BETWEEN 40 AND 50 THEN 'NETWORK MIGRATION' ELSE 'STREET' END AS found_name,
    CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status,
    CASE WHEN value BETWEEN 60 AND 70 THEN strftime(seen, '/%m/%Y %H:%M') WHEN CAST(floor(value) AS BIGINT) % 3 = 0
         THEN strftime(seen, '%m/%d/%Y %H:%M') ELSE strftime(seen, '%d/%m/%Y %H:%M') END AS received_time
  FROM (SELECT *, ts + to_days(unnest(CASE WHEN value < 30 THEN [0, 1] ELSE [0] END)) AS seen FROM events WHERE event_type = 'error')
),
parts AS (
  SELECT *, regexp_replace(account_id, '[^0-9 ]', '', 'g') AS standardacc,
    regexp_replace(split_part(received_time, '/', 1), '[^0-9 ]', '', 'g') AS p1,
    regexp_replace(split_part(received_time, '/', 2), '[^0-9 ]', '', 'g') AS p2,
    regexp_replace(split_part(split_part(received_time, '/', 3), ' ', 1), '[^0-9 ]', '', 'g') AS p3
  FROM register WHERE lower(cust_type) LIKE '%residential%' AND found_name <> 'NETWORK MIGRATION'
),
defs AS (
  SELECT *,
    CASE WHEN CAST(p2 AS INT) > 12 AND CAST(p1 AS INT) <= 12 THEN CAST(p1 AS INT) WHEN CAST(p2 AS INT) < 12 THEN CAST(p2 AS INT) END AS month_def,
    CASE WHEN CAST(p2 AS INT) > 12 AND CAST(p1 AS INT) <= 12 THEN CAST(p2 AS INT)
         WHEN CAST(p2 AS INT) < 12 AND CAST(p1 AS INT) <= 31 THEN CAST(p1 AS INT) END AS day_def
  FROM parts WHERE p1 <> '' AND p2 <> '' AND p3 <> ''
),
closed_tickets AS (
  SELECT ticket_number, CAST(CAST(standardacc AS BIGINT) AS VARCHAR) AS account,
    CASE WHEN length(standardacc) = 8 THEN 'CERILLION' ELSE 'LIBERATE' END AS crm,
    CAST(strptime(day_def || '-' || month_def || '-' || p3, '%d-%m-%Y') AS DATE) AS received
  FROM defs WHERE length(standardacc) IN (8, 12) AND status = 'CLOSED'
)
"""

SQL["clean_tickets"] = with_(TICKETS) + """
SELECT * FROM closed_tickets
UNION ALL SELECT ticket_number, CAST(CAST(standardacc AS BIGINT) AS VARCHAR), CASE WHEN length(standardacc) = 8 THEN 'CERILLION' ELSE 'LIBERATE' END, NULL
FROM parts WHERE (p1 = '' OR p2 = '' OR p3 = '') AND length(standardacc) IN (8, 12) AND status = 'CLOSED'
"""

SQL["early_tickets_two_systems"] = with_(SNAP, INTER, TICKETS, f"""
served AS (SELECT act_acct_cd, min(act_cust_strt_dt) AS start FROM snap WHERE act_acct_stat IN ('ACTIVO', 'SUSPENDIDO')
           AND act_cust_typ = 'RESIDENCIAL' GROUP BY ALL),
grouped AS (SELECT ticket_number, account, min(received) AS received FROM closed_tickets WHERE received > DATE '2024-01-02' GROUP BY ALL),
register_early AS (SELECT account, max(CASE WHEN trunc(date_diff('day', start, received) / 7.0) <= 1 THEN 1 ELSE 0 END) AS early_tickets, start AS sales_month
          FROM grouped LEFT JOIN served ON account = act_acct_cd GROUP BY account, start),
jcalls AS (
  SELECT {wk('interaction_start_time')} AS m, interaction_id, account_id AS account, min(CAST(interaction_start_time AS DATE)) AS day
  FROM inter WHERE CAST(account_id AS BIGINT) % 3 <> 2 GROUP BY ALL),
calls_early AS (SELECT account, max(CASE WHEN trunc(date_diff('day', start, day) / 7.0) <= 1 THEN 1 ELSE 0 END) AS early_tickets, {wk('start')} AS sales_month
          FROM jcalls LEFT JOIN served ON account = act_acct_cd GROUP BY account, {wk('start')})
""") + """
SELECT DISTINCT * FROM (SELECT * FROM register_early UNION ALL SELECT * FROM calls_early)
"""

SQL["rgu_movement_report"] = with_(SNAP, FEAT, BASE) + f"""
SELECT fixed_month, main_movement, gain_movement, count(DISTINCT fixed_account) AS customers,
  {", ".join(f"CAST(coalesce(sum({s}_rgu_{p}) FILTER (WHERE e_overdue <= 90 OR e_overdue IS NULL), 0) AS BIGINT) AS {n}_{p}"
             for s, n in (("b", "opening"), ("e", "closing")) for p in ("vo", "tv", "bb"))},
  {", ".join(f"CAST(sum(ifnull(e_rgu_{p} - b_rgu_{p}, 0)) AS BIGINT) AS change_{p}" for p in ("vo", "tv", "bb"))},
  CAST(coalesce(sum(e_num_rgus - b_num_rgus), 0) AS BIGINT) AS change_total
FROM (SELECT *, CASE WHEN active_bom = 0 AND active_eom = 1 AND {wk('e_max_inst')} = fixed_month THEN 'Gross-Ads'
                     WHEN active_bom = 0 AND active_eom = 1 AND {wk('e_max_inst')} <> fixed_month THEN 'ComeBackToLife/Rejoiners Gross-Ads' END AS gain_movement
      FROM base)
GROUP BY fixed_month, main_movement, gain_movement
"""

SQL["voluntary_flag_count"] = """
SELECT CAST(ts AS DATE) AS dt, count(*) AS voluntary_lines FROM events
WHERE event_type IN ('error', 'signup') AND value >= 20 AND user_id % 5 <> 0 AND user_id % 7 <> 0
  AND (user_id % 3 = 0 OR strftime(CAST(ts AS DATE) + CAST(user_id % 20 AS INTEGER), '%Y-%d-%m') > '2024-15-01')
GROUP BY ALL
"""

SQL["churn_by_end_records"] = with_(SNAP, FEAT, BASE, """
ends AS (SELECT month AS m, act_acct_cd AS a, min(dt) AS f, max(dt) AS l FROM rep GROUP BY ALL),
ok_first AS (SELECT DISTINCT m, a FROM rep JOIN ends ON a = act_acct_cd AND dt = f AND month = m WHERE fi_outst_age <= 4),
over_last AS (SELECT DISTINCT m, a, date_diff('day', max_inst, dt) AS days FROM rep JOIN ends ON a = act_acct_cd AND dt = l AND month = m
              WHERE fi_outst_age >= 4),
net AS (SELECT m, a, days FROM ok_first JOIN over_last USING (m, a))
""") + """
SELECT fixed_month, fixed_account, CASE WHEN a IS NOT NULL THEN '1. Fixed Churner' ELSE '2. Non-churner' END AS fixed_churn_flag,
  CASE WHEN a IS NOT NULL THEN '2. Fixed Involuntary Churner' ELSE '2.Non-Churners' END AS fixed_churn_type_flag,
  CAST(days AS INTEGER) AS churn_tenure_days,
  CASE WHEN days <= 6 THEN '0.Early-tenure Churner' WHEN days > 6 THEN '1.Late-tenure Churner' ELSE '2.Non-Churner' END AS churn_tenure_segment
FROM base LEFT JOIN net ON fixed_month = m AND fixed_account = a
"""

SQL["churners_by_deinstallation"] = with_(SNAP, FEAT, BASE, CHURN, SORDERS, UNINST, f"""
lost AS (SELECT DISTINCT fixed_month, fixed_account FROM base WHERE active_bom = 1 AND (active_eom = 0 OR active_eom IS NULL)),
dein AS (SELECT DISTINCT {wk('order_start_date')} AS d_month, account_name FROM u),
voldein AS (SELECT * FROM lost JOIN dein ON account_name = fixed_account AND date_diff('day', d_month, fixed_month) / 7 <= 1)
""") + """
SELECT DISTINCT coalesce(fixed_month, i_month) AS churn_month, coalesce(fixed_account, i_acct) AS churn_account,
  CASE WHEN account_name IS NOT NULL THEN '1. Fixed Voluntary Churner' ELSE invol_churner END AS fixed_churner_type
FROM voldein FULL OUTER JOIN invol ON d_month = i_month AND i_acct = account_name
"""

SQL["mobile_movement_presto"] = with_(MOBILE) + """
SELECT mobile_month, mobile_movement_flag, count(DISTINCT mobile_account) AS lines, count(*) AS n_rows FROM (
  SELECT mobile_month, mobile_account,
    CASE WHEN mobile_active_bom = 1 AND mobile_active_eom = 1 AND b_mobile_mrc = e_mobile_mrc THEN '01.Maintain'
         WHEN mobile_active_bom = 1 AND mobile_active_eom = 1 AND b_mobile_mrc > e_mobile_mrc THEN '02.Downspin'
         WHEN mobile_active_bom = 1 AND mobile_active_eom = 1 AND b_mobile_mrc < e_mobile_mrc THEN '03.Upspin'
         WHEN mobile_active_bom = 1 AND mobile_active_eom = 0 THEN '04.Loss'
         WHEN b_mobile_mrc IS NULL OR e_mobile_mrc IS NULL THEN '07.MRC Gap' END AS mobile_movement_flag
  FROM mbase0) GROUP BY ALL
"""

_SEG = "e_fmc_segment, e_fmc_type, e_final_tech_flag, e_tenure_final_flag"
_KEPT = "final_churn_flag NOT IN ('Fixed Churner', 'Customer Gap', 'Full Churner', 'Churn Exception')"

SQL["driver_segments"] = with_(*FMC_ALL, INTER, SORDERS, DRIVERS) + f"""
SELECT month, {_SEG}, count(DISTINCT fixed_account) AS activebase, {", ".join(f"count(DISTINCT {c}) AS {c}" for c in _DFLAGS)}
FROM dmaster WHERE {_KEPT} AND fixed_account IS NOT NULL GROUP BY month, {_SEG}
"""

SQL["contact_segments"] = with_(*FMC_ALL, INTER, CONTACTS) + f"""
SELECT s.*, d.ticket_density FROM (
  SELECT month, {_SEG}, count(DISTINCT fixed_account) AS activebase, {", ".join(f"count(DISTINCT {c}) AS {c}" for c in _CFLAGS)}
  FROM cmaster WHERE {_KEPT} AND fixed_account IS NOT NULL GROUP BY month, {_SEG}) s
LEFT JOIN (SELECT month, {_SEG}, CAST(sum(num_tech_tickets) AS BIGINT) AS ticket_density FROM cmaster WHERE {_KEPT} GROUP BY month, {_SEG}) d
  ON s.month = d.month AND {" AND ".join(f"s.{c.strip()} IS NOT DISTINCT FROM d.{c.strip()}" for c in _SEG.split(","))}
"""

SQL["user_base_by_mix"] = with_(SNAP, FEAT, BASE, CHURN) + """
SELECT fixed_month, e_mix, e_fixed_tenure_segment, e_tech_flag, count(DISTINCT fixed_account) AS users
FROM fixed_table WHERE active_eom = 1 GROUP BY ALL
"""

SQL["churn_by_order_type"] = with_(SNAP, FEAT, BASE, SORDERS, UNINST, f"""
per AS (SELECT account_name AS oa, {wk('order_start_date')} AS om,
               max(CASE WHEN order_reason = 'MOROSIDAD' THEN 1 ELSE 0 END) AS inv FROM u GROUP BY ALL)
""") + """
SELECT fixed_month, CASE WHEN inv = 1 THEN 'NON PAY' ELSE 'V_DISCO' END AS order_churn_type, active_eom,
       count(*) AS accounts
FROM base JOIN per ON fixed_account = oa AND fixed_month = om GROUP BY ALL
"""

SQL["voluntary_counts"] = with_(SORDERS, UNINST) + """
SELECT order_start_date AS day, count(*) AS voluntary_lines FROM u WHERE order_reason <> 'MOROSIDAD' GROUP BY ALL
"""

# --- sales channel, driver percentages, callers by month --------------------
SQL["sales_channel"] = with_(SORDERS, """
inst AS (SELECT * FROM sorders WHERE order_type = 'INSTALACION' AND order_status = 'FINALIZADA'),
fc AS (SELECT account_name AS account, channel_desc AS sales_channel FROM (
         SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY order_start_date, order_id) AS rn FROM inst)
       WHERE rn = 1)
""") + f"""
SELECT DISTINCT i.account_name AS account, {wk('i.order_start_date')} AS month, fc.sales_channel
FROM inst i JOIN fc ON fc.account = i.account_name
"""

SQL["sales_channel_groups"] = "SELECT *, upper(regexp_extract(sales_channel, '^[^ _-]+')) AS channel_group FROM (" + SQL["sales_channel"] + ") q\n"

SQL["mounting_bills"] = with_(SNAP) + f"""
SELECT DISTINCT b.act_acct_cd AS account, b.dt AS month, k.n AS snapshots
FROM snap a JOIN snap b ON a.act_acct_cd = b.act_acct_cd AND a.oldest_unpaid_bill_dt = b.oldest_unpaid_bill_dt
JOIN (VALUES (2), (3)) k(n) ON b.dt = CAST(a.dt + 7 * (k.n - 1) AS DATE)
WHERE a.dt = {wk('a.dt')} AND b.bill_dt_m0 IS NOT NULL
"""

_RATES = ["early_issue_flag", "tech_call_flag", "soft_dx_flag", "never_paid_flag", "long_install_flag"]

SQL["driver_percentages"] = "SELECT month, " + ", ".join(
    f"round(CAST({f} AS DOUBLE) / NULLIF(monthsale_flag, 0), 4) AS {f}_rate" for f in _RATES) + \
    " FROM (" + SQL["driver_summary"] + ") ds\n"

SQL["callers_by_month"] = with_(INTER) + f"""
SELECT month, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_call,
       CAST(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS two_calls,
       CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS multiple_calls
FROM (SELECT account_id, {wk('CAST(interaction_start_time AS DATE)')} AS month, count(DISTINCT interaction_id) AS n
      FROM inter WHERE interaction_status <> 'ANULADA' AND interaction_purpose_descrip NOT IN ({_sqlist(_L.NON_CALL_PURPOSES)})
      GROUP BY ALL) GROUP BY month
"""

# --- history ingest, backfill, activity by charge -----------------------------
SQL["ticket_history"] = with_(INTER, SORDERS) + f"""
SELECT account_id AS contrato, interaction_id AS tiquete, CAST(interaction_start_time AS DATE) AS fecha_apertura,
       interaction_status AS estado, interaction_purpose_descrip AS clase, 'TICKETS' AS fuente
FROM inter WHERE interaction_purpose_descrip IN ({_sqlist(_L.TECH_TICKET_PURPOSES)})
  AND year(CAST(interaction_start_time AS DATE)) = 2024
UNION ALL
SELECT account_name, CAST(order_id AS VARCHAR), order_start_date, order_status, order_type, 'ORDENES'
FROM sorders WHERE year(order_start_date) = 2024
"""

SQL["backfill_product"] = with_(SNAP, f"""
ref AS (SELECT act_acct_cd AS ra, pd_vo_prod_nm AS rp FROM (
          SELECT *, row_number() OVER (PARTITION BY act_acct_cd ORDER BY dt DESC) AS rn FROM snap
          WHERE {wk('dt')} = DATE '2024-01-01' AND pd_vo_prod_nm IS NOT NULL) WHERE rn = 1)
""") + """
SELECT act_acct_cd, dt, CASE WHEN dt >= DATE '2024-01-15' THEN coalesce(pd_vo_prod_nm, rp) ELSE pd_vo_prod_nm END AS pd_vo_prod_nm
FROM snap LEFT JOIN ref ON ra = act_acct_cd
"""

SQL["active_by_mrc"] = with_(SNAP, f"""
am AS (SELECT act_acct_cd AS aa, {wk('dt')} AS am_month, avg(fi_vo_mrc_amt) AS a FROM snap WHERE fi_vo_mrc_amt <> 0 GROUP BY ALL)
""") + f"""
SELECT {wk('dt')} AS month, count(*) AS rows_kept, count(DISTINCT act_acct_cd) AS accounts
FROM snap LEFT JOIN am ON aa = act_acct_cd AND am_month = {wk('dt')}
WHERE a IS NOT NULL OR date_diff('day', act_cust_strt_dt, dt) <= 7 GROUP BY ALL
"""

# --- service delivery, digital payments --------------------------------------
SDW = """
sdw0 AS (
  SELECT CAST(date_trunc('week', order_start_date) AS DATE) + 6 AS end_week_date,
    count(DISTINCT account_name) AS total_subscribers,
    count(CASE WHEN order_type = 'INSTALACION' AND order_status = 'FINALIZADA' THEN 1 END) AS assisted_installations,
    avg(CASE WHEN order_type = 'INSTALACION' AND order_status = 'FINALIZADA' THEN date_diff('day', order_start_date, completed_date) END) AS mtti,
    count(CASE WHEN order_type = 'DESINSTALACION' THEN 1 END) AS truck_rolls,
    avg(CASE WHEN order_type = 'DESINSTALACION' THEN date_diff('day', order_start_date, completed_date) END) AS mttr,
    count(CASE WHEN order_type = 'INSTALACION' AND order_status <> 'FINALIZADA' THEN 1 END) * 100.0
      / NULLIF(count(CASE WHEN order_type = 'INSTALACION' THEN 1 END), 0) AS i_elf_28days,
    count(CASE WHEN order_type = 'DESINSTALACION' AND order_status <> 'FINALIZADA' THEN 1 END) * 100.0
      / NULLIF(count(CASE WHEN order_type = 'DESINSTALACION' THEN 1 END), 0) AS r_elf_28days
  FROM sorders GROUP BY ALL
),
sdw AS (
  SELECT *, truck_rolls * 1000.0 / NULLIF(total_subscribers, 0) AS scr, 'OVERALL' AS network FROM sdw0
  UNION ALL
  SELECT * REPLACE (assisted_installations * 2 AS assisted_installations), truck_rolls * 1000.0 / NULLIF(total_subscribers, 0), 'HFC' FROM sdw0
),
sdwk AS (
  SELECT CAST(date_trunc('month', end_week_date) AS DATE) AS month, network, end_week_date,
    sum(assisted_installations) AS i, sum(mtti) AS t_i, sum(truck_rolls) AS r, sum(mttr) AS t_r, sum(scr) AS scr,
    sum(i_elf_28days) AS ie, sum(r_elf_28days) AS re
  FROM sdw WHERE network = 'OVERALL' GROUP BY ALL
)
"""

SQL["service_delivery"] = with_(SORDERS, SDW) + """
SELECT month, CAST(sum(i) AS BIGINT) AS install, round(sum(i * t_i) / NULLIF(CAST(sum(i) AS DOUBLE), 0), 2) AS mtti,
       CAST(sum(r) AS BIGINT) AS repairs, round(sum(r * t_r) / NULLIF(CAST(sum(r) AS DOUBLE), 0), 2) AS mttr,
       round(sum(scr), 2) AS repairs_1k_rgu,
       round(sum((100 - ie) * i) / NULLIF(CAST(sum(i) AS DOUBLE), 0) / 100, 4) AS ftr_install,
       round(sum((100 - re) * r) / NULLIF(CAST(sum(r) AS DOUBLE), 0) / 100, 4) AS ftr_repair
FROM sdwk GROUP BY month
"""

SQL["digital_payment_share"] = """
SELECT month, 'TEST' AS market, 'digital_payment_share' AS kpi_name,
       round(CAST(digital AS DOUBLE) / NULLIF(pymt_cnt, 0), 2) AS measure, CAST(digital AS DOUBLE) AS numerator,
       CAST(pymt_cnt AS DOUBLE) AS denominator, 'M-0' AS kpi_delay
FROM (SELECT CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS month,
             count(DISTINCT CASE WHEN l_returnflag = 'N' THEN CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END) AS digital,
             count(DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)) AS pymt_cnt
      FROM lineitem GROUP BY ALL)
"""

# --- CRM matching, cancelled lines, phones, households ------------------------
SQL["churn_order_matching"] = with_(SORDERS, UNINST, """
crm AS (SELECT CAST(user_id AS VARCHAR) AS account, max(CAST(ts AS DATE)) AS churn_date FROM events
        WHERE event_type = 'error' AND value >= 150 GROUP BY ALL),
cj AS (SELECT crm.account, churn_date, order_id, order_start_date, order_reason,
              row_number() OVER (PARTITION BY crm.account, churn_date ORDER BY order_start_date DESC, order_id DESC) AS rn
       FROM crm JOIN u ON u.account_name = crm.account
       WHERE order_start_date <= churn_date AND order_start_date >= CAST(churn_date - 21 AS DATE))
""") + """
SELECT account, churn_date, order_id, order_start_date AS order_date,
       CASE WHEN order_reason = 'MOROSIDAD' THEN '2. Fixed Involuntary Churner' WHEN order_reason IS NOT NULL THEN '1. Fixed Voluntary Churner' END AS churn_type
FROM cj WHERE rn = 1
"""

SQL["voluntary_by_lines"] = with_(SNAP, SORDERS, """
canc AS (SELECT account_name AS account, order_start_date AS cancel_date FROM sorders
         WHERE order_type = 'DESINSTALACION' AND order_reason = 'VOLUNTARIO'),
lc AS (SELECT c.account, c.cancel_date AS last_cancel, count(*) AS cancelled_lines FROM canc c
       JOIN (SELECT account, max(cancel_date) AS m FROM canc GROUP BY ALL) x ON x.account = c.account AND x.m = c.cancel_date
       GROUP BY ALL),
lr AS (SELECT act_acct_cd, dt AS last_record, fi_outst_age AS age,
              (CASE WHEN pd_vo_prod_nm IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN pd_tv_prod_nm IS NOT NULL THEN 1 ELSE 0 END)
              + (CASE WHEN pd_bb_prod_nm IS NOT NULL THEN 1 ELSE 0 END) AS n
       FROM (SELECT *, row_number() OVER (PARTITION BY act_acct_cd ORDER BY dt DESC) AS rn FROM snap) WHERE rn = 1)
""") + """
SELECT account, last_cancel, cancelled_lines, last_record,
       CASE WHEN age >= 4 THEN '2.Fixed Mixed Churner' ELSE '1.Fixed Voluntary Churner' END AS churn_type
FROM lc JOIN lr ON act_acct_cd = account WHERE cancelled_lines = n
"""

SQL["phone_match"] = with_(SNAP, MOBILE, """
fc AS (SELECT act_acct_cd, min(act_contact_phone_1) AS own FROM snap GROUP BY ALL),
ph AS (
  SELECT act_acct_cd, 1 AS priority, CASE WHEN CAST(act_acct_cd AS BIGINT) % 2 = 0 THEN own ELSE '7000000' END AS phone FROM fc
  UNION ALL SELECT act_acct_cd, 2, '6' || lpad(CAST(CAST(act_acct_cd AS BIGINT) + 1 AS VARCHAR), 7, '0') FROM fc
  UNION ALL SELECT act_acct_cd, 3, own FROM fc
),
mp AS (SELECT DISTINCT num_telefono AS phone FROM reg WHERE num_telefono IS NOT NULL)
""") + """
SELECT act_acct_cd, coalesce(arg_min(mp.phone, CASE WHEN mp.phone IS NOT NULL THEN priority END),
         max(CASE WHEN priority = 1 THEN ph.phone END)) AS matched_phone,
       min(CASE WHEN mp.phone IS NOT NULL THEN priority END) AS phone_priority
FROM ph LEFT JOIN mp ON ph.phone = mp.phone GROUP BY act_acct_cd
"""

SQL["household_match"] = with_(SNAP, FEAT, BASE, MOBILE, f"""
hf AS (SELECT DISTINCT CAST(CAST(act_acct_cd AS BIGINT) // 4 AS BIGINT) AS household_id, dt, act_acct_cd AS member
       FROM snap WHERE EXISTS (SELECT 1 FROM base WHERE fixed_account = act_acct_cd AND fixed_month = {wk('dt')})),
hm AS (SELECT DISTINCT CAST(CAST(regexp_replace(line, '^8', '') AS BIGINT) // 4 AS BIGINT) AS household_id, dt, line AS member
       FROM (SELECT replace(id_abonado, '.', '') AS line, fecha_parque AS dt FROM reg WHERE id_abonado <> '') r
       WHERE EXISTS (SELECT 1 FROM mbase0 WHERE mobile_account = line AND mobile_month = {wk('dt')})),
links AS (SELECT hf.household_id, hf.dt, hf.member AS account, hm.member AS line
          FROM hf JOIN hm ON hf.household_id = hm.household_id AND hf.dt = hm.dt),
pr AS (SELECT household_id, dt, min(account) AS fmc_fixed, min(line) AS fmc_mobile, count(DISTINCT account) AS n_fixed,
              count(DISTINCT line) AS n_mobile FROM links GROUP BY ALL)
""") + """
SELECT household_id, dt, 'fixed' AS side, account AS member, fmc_fixed, fmc_mobile, n_fixed, n_mobile
FROM (SELECT DISTINCT household_id, dt, account FROM links) JOIN pr USING (household_id, dt)
UNION ALL
SELECT household_id, dt, 'mobile', line, fmc_fixed, fmc_mobile, n_fixed, n_mobile
FROM (SELECT DISTINCT household_id, dt, line FROM links) JOIN pr USING (household_id, dt)
"""

# --- customer-experience dashboard ---------------------------------------------
def _cx_row(kpi, facet, journey, meas, num, den, source, delay="M-0", size="large"):
    none = "CAST(NULL AS DOUBLE)"
    return (f"SELECT month, '{size}' AS market_size, '{facet}' AS facet, '{journey}' AS journey_waypoint, '{kpi}' AS kpi_name, "
            f"CAST({meas or none} AS DOUBLE) AS kpi_meas, CAST({num or none} AS DOUBLE) AS kpi_num, "
            f"CAST({den or none} AS DOUBLE) AS kpi_den, '{delay}' AS kpi_delay FROM {source}")


def _cx_ratio(kpi, facet, journey, num, den, source, digits=4, factor="", delay="M-0"):
    return _cx_row(kpi, facet, journey, f"round(CAST({num} AS DOUBLE) {factor} / NULLIF({den}, 0), {digits})", num, den, source, delay)


_CX_ROWS = [
    _cx_row("Gross_Adds", "contact_drivers", "buy", "gross_adds", "0", "0", "cxm"),
    _cx_row("Active_Base", "contact_drivers", "use", "active_base", "0", "0", "cxm"),
    _cx_row("Active_Base", "contact_drivers", "support-call", "active_base", "0", "0", "cxm"),
    _cx_ratio("Tech_Tix_per_100_Acct", "contact_intensity", "use", "ticket_density", "activebase", "cxc"),
    _cx_ratio("%Customers_w_MRC_Changes_5%+_excl_plan", "contact_drivers", "pay", "increase_flag", "no_plan_change_flag", "cxd"),
    _cx_ratio("%New_Sales_to_Soft_Dx", "high_risk", "buy", "soft_dx_flag", "monthsale_flag", "cxd", delay="M-1"),
    _cx_ratio("%New_Customer_Callers_2+calls_21days", "high_risk", "buy", "early_issue_flag", "monthsale_flag", "cxd", delay="M-1"),
    _cx_ratio("%breech_cases_install_6+days", "high_risk", "get", "long_install_flag", "monthsale_flag", "cxd", delay="M-1"),
    _cx_ratio("%Early_Tech_Tix_-7weeks", "high_risk", "get", "tech_call_flag", "monthsale_flag", "cxd", delay="M-2"),
    _cx_ratio("%Repeat_Callers_2+calls", "high_risk", "support-call", "(two_call_flag + multiple_call_flag)", "activebase", "cxc", delay="M-2"),
    _cx_ratio("tech_calls_per_1k_rgu", "contact_intensity", "support-call", "tickets", "rgus", "cxm", 0, "* 1000"),
    _cx_ratio("care_calls_per_1k_rgu", "contact_intensity", "support-call", "calls", "rgus", "cxm", 0, "* 1000"),
    _cx_ratio("Billing Calls per Bill Variation", "contact_intensity", "pay", "bcalls", "variations", "cxm", 3),
    _cx_ratio("%FTR_Billing", "effectiveness", "pay", "resolved", "billing_calls", "cxm", 6),
    _cx_row("%Customers_w_Mounting_Bills", "high_risk", "pay", "mounting_bill_flag", None, None, "cxd", size="Large"),
    *[_cx_row(kpi, facet, journey, c, None, None, "cxs", size="Large") for kpi, facet, journey, c in (
        ("Installs", "contact_drivers", "get", "install"), ("MTTI", "customer_time", "get", "mtti"),
        ("%FTR_installs", "effectiveness", "get", "ftr_install"), ("Repairs", "contact_drivers", "support-tech", "repairs"),
        ("MTTR", "customer_time", "support-tech", "mttr"), ("%FTR_Repair", "effectiveness", "support-tech", "ftr_repair"),
        ("Repairs_per_1k_rgu", "contact_intensity", "support-tech", "repairs_1k_rgu"))],
    *[_cx_row(kpi, facet, journey, None, None, None, "cxm", size="Large") for kpi, facet, journey in (
        ("%eCommerce", "digital_shift", "buy"), ("tBuy", "NPS_Detractorship", "buy"), ("MTTB", "customer_time", "buy"),
        ("Buying_Calls/GA", "contact_intensity", "buy"), ("tInstall", "NPS_Detractorship", "get"),
        ("%self_installs", "digital_shift", "get"), ("Install_Calls/Installs", "contact_intensity", "get"),
        ("MTTBTR", "customer_time", "pay"), ("tpay", "NPS_Detractorship", "pay"), ("tHelp_Care", "NPS_Detractorship", "support-call"),
        ("%FRC_Care", "effectiveness", "support-call"), ("tHelp_repair", "NPS_Detractorship", "support-tech"),
        ("%_High_Tech_Call_Nodes_+6%monthly", "high_risk", "use"), ("pNPS", "NPS_Detractorship", "use"),
        ("%CC_SL_Care", "customer_time", "support-call"), ("%CC_SL_Tech", "customer_time", "support-call"),
        ("%Chatbot_containment_care", "digital_shift", "support-call"), ("%Chatbot_containment_Tech", "digital_shift", "support-tech"),
        ("%digital_payments", "digital_shift", "pay"))],
]


CX = f"""
cxd_acct AS (
  SELECT month, fixed_account, {", ".join(f"max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS {c}" for c in _DFLAGS)}
  FROM dmaster WHERE final_churn_flag NOT IN ('Fixed Churner', 'Customer Gap', 'Full Churner', 'Churn Exception')
    AND fixed_account IS NOT NULL GROUP BY ALL),
cxd AS (SELECT month, {", ".join(f"sum({c}) AS {c}" for c in _DFLAGS)} FROM cxd_acct GROUP BY month),
cxc_acct AS (
  SELECT month, fixed_account, {", ".join(f"max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS {c}" for c in _CFLAGS)}
  FROM cmaster WHERE final_churn_flag NOT IN ('Fixed Churner', 'Customer Gap', 'Full Churner', 'Churn Exception')
    AND fixed_account IS NOT NULL GROUP BY ALL),
cxc AS (SELECT s.*, d.ticket_density FROM (SELECT month, count(*) AS activebase, {", ".join(f"sum({c}) AS {c}" for c in _CFLAGS)} FROM cxc_acct GROUP BY month) s
  LEFT JOIN (SELECT month, sum(num_tech_tickets) AS ticket_density FROM cmaster
             WHERE final_churn_flag NOT IN ('Fixed Churner', 'Customer Gap', 'Full Churner', 'Churn Exception') GROUP BY month) d ON s.month = d.month),
cxs_week AS (SELECT {wk('end_week_date')} AS month, * EXCLUDE (month) FROM sdwk),
cxs AS (SELECT month, sum(i) AS install, round(sum(i * t_i) / NULLIF(CAST(sum(i) AS DOUBLE), 0), 2) AS mtti, sum(r) AS repairs,
    round(sum(r * t_r) / NULLIF(CAST(sum(r) AS DOUBLE), 0), 2) AS mttr, round(sum(scr), 2) AS repairs_1k_rgu,
    round(sum((100 - ie) * i) / NULLIF(CAST(sum(i) AS DOUBLE), 0) / 100, 4) AS ftr_install,
    round(sum((100 - re) * r) / NULLIF(CAST(sum(r) AS DOUBLE), 0) / 100, 4) AS ftr_repair FROM cxs_week GROUP BY month),
cxm AS (SELECT g.*, kc.tickets, kc.calls, rg.rgus, cpv.calls AS bcalls, coalesce(cpv.variations, 0) AS variations, fp.resolved, fp.billing_calls
  FROM (SELECT month, count(DISTINCT CASE WHEN main_movement = '05. New Customer' THEN fixed_account END) AS gross_adds,
               count(DISTINCT fixed_account) AS active_base FROM km GROUP BY month) g
  JOIN kc ON kc.month = g.month JOIN rg ON rg.month = g.month JOIN fp ON fp.month = g.month LEFT JOIN cpv ON cpv.month = g.month),
cx AS (SELECT DISTINCT month, 'TT' AS opco, 'Test' AS market, 'Fixed' AS product, 'B2C' AS biz_unit, * EXCLUDE (month) FROM (
  {" UNION ALL ".join(_CX_ROWS)}))
"""

_CX_ALL = with_(*FMC_ALL, INTER, SORDERS, DRIVERS, CONTACTS, FTR, KPI, SDW, CX)

SQL["cx_dashboard"] = _CX_ALL + """
SELECT month, opco, market, market_size, product, biz_unit, facet, journey_waypoint, kpi_name, kpi_meas, kpi_num, kpi_den, kpi_delay FROM cx
"""

SQL["cx_dashboard_overall"] = _CX_ALL + """
SELECT DISTINCT month, opco, market, market_size, product, biz_unit, facet, journey_waypoint, kpi_name,
  round(CASE WHEN kpi_num IS NULL AND kpi_den IS NULL THEN sum(kpi_meas)
             WHEN kpi_num IS NOT NULL AND kpi_den IS NOT NULL THEN sum(kpi_num) / NULLIF(sum(kpi_den), 0) END, 6) AS kpi_meas,
  coalesce(sum(kpi_num), 0) AS kpi_numm, coalesce(sum(kpi_den), 0) AS kpi_denn, 'Overall' AS network,
  CAST(year(month) AS INTEGER) AS ref_year, CAST(month(month) AS INTEGER) AS ref_mo
FROM cx GROUP BY month, opco, market, market_size, product, biz_unit, facet, journey_waypoint, kpi_name, kpi_num, kpi_den
"""

# --- churn by CRM date, FMC list patch ----------------------------------------
SQL["churn_by_crm"] = with_(SNAP, """
per AS (SELECT act_acct_cd AS account, max(cst_chrn_dt) AS last_churn, min(cst_chrn_dt) AS first_churn, max(dt) AS ls,
               min(CASE WHEN (fi_outst_age >= 2 AND pd_bb_prod_nm IS NOT NULL)
                          OR (fi_outst_age >= 4 AND (pd_tv_prod_nm IS NOT NULL OR pd_vo_prod_nm IS NOT NULL))
                        THEN cst_chrn_dt END) AS ic, max(c_cust_age) AS ma
        FROM snap GROUP BY ALL)
""") + f"""
SELECT account, {wk('last_churn')} AS churn_month,
       CASE WHEN ic IS NOT NULL AND ic <= last_churn THEN 'Involuntary' ELSE 'Voluntary' END AS churn_type,
       CASE WHEN ma <= 7 THEN 'Early Tenure' WHEN ma IS NOT NULL THEN 'Long Tenure' END AS tenure
FROM per WHERE {wk('last_churn')} = {wk('ls')} AND first_churn <= last_churn
"""

SQL["fmc_patch"] = with_(*FMC_ALL, f"""
fl0 AS (
  SELECT user_id, {wk('CAST(ts AS DATE)')} AS dt,
         min(CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) END) AS s0,
         min(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS p0,
         count(CASE WHEN event_type = 'signup' THEN 1 END) AS n
  FROM events GROUP BY ALL
),
fl AS (
  SELECT CAST(user_id AS VARCHAR) AS account, dt AS f, CAST(greatest(s0, p0) AS DATE) AS s,
         CASE WHEN n >= 3 THEN 'FMC' ELSE 'Service Not Found' END AS service_type
  FROM fl0 WHERE s0 IS NOT NULL AND p0 IS NOT NULL
),
listed AS (
  SELECT DISTINCT account, month FROM (
    SELECT account, CAST(f + 7 AS DATE) AS month FROM fl WHERE service_type <> 'Service Not Found'
    UNION ALL
    SELECT account, {wk('s')} FROM fl WHERE service_type <> 'Service Not Found' AND {wk('s')} = CAST(f - 7 AS DATE))
)
""") + """
SELECT t.month, final_account, CASE WHEN l.account IS NOT NULL THEN 1 ELSE 0 END AS fmc_listed,
  CASE WHEN l.account IS NOT NULL AND b_mix IS NULL THEN 'Mobile Only' WHEN l.account IS NOT NULL THEN 'Soft/Hard FMC'
       WHEN b_mix IS NULL AND c.month IS NOT NULL AND mobile_active_bom <> 1 THEN NULL ELSE b_fmc_type END AS b_fmc_type_final,
  CASE WHEN l.account IS NULL AND mobile_active_eom = 1 AND c.month IS NOT NULL AND e_mix IS NULL THEN 'Mobile Only'
       WHEN l.account IS NOT NULL AND e_mix IS NULL AND mobile_active_eom = 1 THEN 'Mobile Only'
       WHEN l.account IS NOT NULL AND active_eom = 1 THEN 'Soft/Hard FMC'
       WHEN e_mix IS NULL AND c.month IS NOT NULL AND mobile_active_bom <> 1 THEN NULL ELSE e_fmc_type END AS e_fmc_type_final,
  CASE WHEN l.account IS NOT NULL AND b_mix IS NULL THEN 'P1_Mobile'
       WHEN b_mix IS NULL AND c.month IS NOT NULL AND mobile_active_bom <> 1 THEN NULL
       WHEN l.account IS NOT NULL AND b_mix = '1P' THEN 'P2' WHEN l.account IS NOT NULL AND b_mix = '2P' THEN 'P3'
       WHEN l.account IS NOT NULL AND b_mix = '3P' THEN 'P4' ELSE b_fmc_segment END AS b_fmc_segment_final,
  CASE WHEN l.account IS NOT NULL AND e_mix IS NULL AND mobile_active_eom = 1 THEN 'P1_Mobile'
       WHEN e_mix IS NULL AND c.month IS NOT NULL AND mobile_active_eom <> 1 THEN NULL
       WHEN l.account IS NOT NULL AND e_mix = '1P' THEN 'P2' WHEN l.account IS NOT NULL AND e_mix = '2P' THEN 'P3'
       WHEN l.account IS NOT NULL AND e_mix = '3P' THEN 'P4' ELSE e_fmc_segment END AS e_fmc_segment_final
FROM fmc_table t LEFT JOIN listed l ON l.account = final_account AND l.month = t.month
  LEFT JOIN (SELECT DISTINCT month FROM listed) c ON c.month = t.month
"""

SQL["scalar_functions"] = with_(SNAP) + """
SELECT act_acct_cd, dt,
  first_value(pd_vo_prod_nm IGNORE NULLS) OVER (PARTITION BY act_acct_cd ORDER BY dt) AS first_vo_name,
  last_value(pd_tv_prod_nm) OVER (PARTITION BY act_acct_cd ORDER BY dt) AS tv_last_default_frame,
  split_part(act_contact_mail_1, '@', 1) AS email_user,
  CASE WHEN isnan(fi_bill_amt_m0) THEN 0.0 ELSE fi_bill_amt_m0 END AS bill_nan_safe,
  CAST(strftime(dt, '%Y%m%d') AS INTEGER) AS date_key,
  right('0000000000' || act_acct_cd, 10) AS padded_key,
  CAST(date_diff('day', dt, last_day(dt)) AS INTEGER) AS days_to_month_end,
  CAST((year(dt + INTERVAL 1 MONTH) - year(act_cust_strt_dt)) * 12 + month(dt + INTERVAL 1 MONTH) - month(act_cust_strt_dt) AS INTEGER) AS months_crossed,
  CAST(datesub('month', CAST(date_trunc('month', act_cust_strt_dt) AS DATE), CAST(dt + INTERVAL 1 MONTH AS DATE)) AS INTEGER) AS months_full,
  abs(fi_vo_mrc_amt - fi_tv_mrc_amt) AS abs_change
FROM snap
"""

SQL["waterfall_bigquery"] = with_(*FMC_ALL) + """
SELECT month, final_account, waterfall_flag, CASE
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_num_rgus < e_num_rgus
       AND (mobile_active_bom = mobile_active_eom OR (mobile_active_bom IS NULL AND mobile_active_eom IS NULL)) THEN 'Upsell'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_num_rgus > e_num_rgus
       AND (mobile_active_bom = mobile_active_eom OR (mobile_active_bom IS NULL AND mobile_active_eom IS NULL)) THEN 'Downsell'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_num_rgus = e_num_rgus AND b_total_mrc = e_total_mrc THEN 'Maintain'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1
       AND ((main_movement = '05. New Customer' AND mobile_movement_flag IN ('06.New Customer', '05.Come Back To Life'))
            OR (main_movement = '05. New Customer' AND mobile_movement_flag IS NULL)
            OR (main_movement IS NULL AND mobile_movement_flag IN ('06.New Customer', '05.Come Back To Life')))
    THEN 'Fixed Gross Add or Mobile Gross Add/ Rejoiner'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_num_rgus = e_num_rgus AND b_total_mrc > e_total_mrc THEN 'Downspin'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_num_rgus = e_num_rgus AND b_total_mrc < e_total_mrc THEN 'Upspin'
  WHEN rejoiner_final_flag IS NOT NULL THEN rejoiner_final_flag
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND active_bom IS NULL AND active_eom IS NULL
       AND mobile_active_bom = 1 AND mobile_active_eom = 1 THEN 'Maintain'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND final_churn_flag = 'Fixed Churner'
       AND ((mobile_active_bom = 1 AND mobile_active_eom = 1) OR (mobile_active_bom IS NULL AND mobile_active_eom IS NULL)) THEN 'Fixed Churner'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 0 AND final_churn_flag = 'Fixed Churner'
       AND ((mobile_active_bom = 1 AND mobile_active_eom = 1) OR (mobile_active_bom IS NULL AND mobile_active_eom IS NULL)) THEN 'Fixed Churner'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND active_bom = 0 AND active_eom = 1
       AND mobile_active_bom = 1 AND mobile_active_eom = 0 THEN 'Fixed Gross Add or Mobile Gross Add/ Rejoiner'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND final_churn_flag = 'Fixed Churner'
       AND mobile_active_bom = 0 AND mobile_active_eom = 1 THEN 'Fixed to Mobile Customer Gap'
  WHEN final_churn_flag = 'Full Churner' THEN 'Full Churner'
  WHEN final_churn_flag = 'Mobile Churner' THEN 'Mobile Churner'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND active_bom = 1 AND active_eom = 0
       AND final_churn_flag = 'Non Churner' THEN 'Churn Gap'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND mobile_active_bom = 0 AND mobile_active_eom = 1
       AND active_bom = 1 AND active_eom = 1 THEN 'Mobile Gross Adds'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND active_bom = 1 AND active_eom = 1
       AND mobile_active_bom = 1 AND mobile_active_eom = 0 THEN 'Mobile Churner'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1 AND e_fmc_segment = 'P1_Fixed'
       AND rejoiner_final_flag IS NULL THEN 'Fixed Gross Add or Mobile Gross Add/ Rejoiner'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND active_bom = 0 AND active_eom = 1
       AND mobile_active_bom = 1 AND mobile_active_eom = 1 THEN 'FMC Packing'
  WHEN b_fmc_status = 'Undefined FMC' OR e_fmc_status = 'Undefined FMC' THEN 'Gap Undefined FMC'
  WHEN final_churn_flag = 'Customer Gap' THEN 'Customer Gap'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1 AND active_bom = 0 AND active_eom = 1
       AND mobile_active_bom = 0 AND mobile_active_eom = 1 THEN 'FMC Gross Add'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1 AND active_bom = 0 AND active_eom = 1
       AND fixed_churner_type IS NOT NULL THEN 'Customer Gap'
END AS waterfall_bq
FROM fmc_table
"""

SQL["never_paid_sales"] = with_(SNAP, """
per AS (SELECT act_acct_cd AS account, max(cst_chrn_dt) AS last_churn, min(cst_chrn_dt) AS first_churn, max(dt) AS ls,
               min(CASE WHEN (fi_outst_age >= 2 AND pd_bb_prod_nm IS NOT NULL)
                          OR (fi_outst_age >= 4 AND (pd_tv_prod_nm IS NOT NULL OR pd_vo_prod_nm IS NOT NULL))
                        THEN cst_chrn_dt END) AS ic,
               min(act_acct_inst_dt) AS inst
        FROM snap GROUP BY ALL)
""") + f"""
SELECT install_month, count(*) AS sales, CAST(sum(np) AS BIGINT) AS never_paid,
       round(CAST(sum(np) AS DOUBLE) / NULLIF(count(*), 0), 3) AS never_paid_share
FROM (SELECT {wk('inst')} AS install_month,
             CASE WHEN {wk('last_churn')} = {wk('ls')} AND first_churn <= last_churn AND ic IS NOT NULL AND ic <= last_churn
                       AND date_diff('day', inst, last_churn) <= 14 THEN 1 ELSE 0 END AS np
      FROM per)
GROUP BY install_month
"""

SQL["waterfall_jamaica"] = with_(*FMC_ALL) + """
SELECT month, waterfall_jm, count(*) AS rows, count(DISTINCT final_account) AS accounts FROM (
SELECT month, final_account, CASE
  WHEN ((final_bom_active_flag = 1 AND final_eom_active_flag = 1) OR (final_bom_active_flag = 1 AND final_eom_active_flag = 0))
       AND coalesce(b_total_rgus, 0.0) > coalesce(e_total_rgus, 0.0) AND main_movement IS NULL
       AND final_churn_flag = 'Non Churner' THEN 'Downsell-Fixed Customer Gap'
  WHEN (active_bom = 1 AND active_eom = 1 AND e_num_rgus = 0 AND fixed_churner_type IS NULL)
       OR (active_bom = 1 AND b_num_rgus = 0)
       OR (fixed_churner_type IS NOT NULL AND coalesce(active_bom, 0) = 0) THEN 'Fixed Base Exceptions'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1
       AND ((main_movement = '05. New Customer' AND mobile_movement_flag = '06.New Customer')
            OR (main_movement = '05. New Customer' AND mobile_movement_flag IS NULL)
            OR (main_movement IS NULL AND mobile_movement_flag = '06.New Customer')) THEN 'Gross Ads'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1
       AND (main_movement = '04. Come Back to Life' OR mobile_movement_flag = '05.Come Back To Life')
       AND rejoiner_final_flag IS NULL THEN 'Gross Ads'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1
       AND ((rejoiner_final_flag IN ('Fixed Rejoiner', 'Mobile Rejoiner') AND e_fmc_type IN ('Soft FMC', 'Near FMC'))
            OR rejoiner_final_flag = 'FMC Rejoiner') THEN 'FMC Rejoiner'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1 AND main_movement = '04. Come Back to Life'
       AND rejoiner_final_flag = 'Fixed Rejoiner' AND e_fmc_segment = 'P1_Fixed' THEN 'Fixed Rejoiner'
  WHEN final_bom_active_flag = 0 AND final_eom_active_flag = 1 AND mobile_movement_flag = '05.Come Back To Life'
       AND rejoiner_final_flag = 'Mobile Rejoiner' AND e_fmc_segment = 'P1_Mobile' THEN 'Mobile Rejoiner'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND rejoiner_final_flag IS NOT NULL THEN 'Semi-rejoiner'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_total_rgus < e_total_rgus THEN 'Upsell'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_total_rgus > e_total_rgus THEN 'Downsell'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_total_rgus = e_total_rgus AND b_total_mrc = e_total_mrc THEN 'Maintain'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_total_rgus = e_total_rgus AND b_total_mrc < e_total_mrc THEN 'Upspin'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 1 AND b_total_rgus = e_total_rgus AND b_total_mrc > e_total_mrc
       AND e_total_mrc <> 0 THEN 'Downspin'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 0 AND final_churn_flag <> 'Non Churner'
       AND churn_type_final_flag = 'Voluntary' THEN 'Voluntary Churners'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 0 AND final_churn_flag <> 'Non Churner'
       AND churn_type_final_flag = 'Involuntary' THEN 'Involuntary Churners'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 0 AND final_churn_flag <> 'Non Churner'
       AND churn_type_final_flag = 'Anticipated Involuntary' THEN 'Anticipated Involuntary Churners'
  WHEN final_bom_active_flag = 1 AND final_eom_active_flag = 0 AND final_churn_flag <> 'Non Churner'
       AND churn_type_final_flag = 'Mixed' THEN 'Mixed Churners'
END AS waterfall_jm
FROM fmc_table) GROUP BY ALL
"""
