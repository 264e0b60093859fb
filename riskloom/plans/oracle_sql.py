"""DuckDB oracle SQL for the registered queries.

Conventions shared with ``queries.py``: doubles are rounded to 6 places on both
sides, every computed column is aliased, counts are BIGINT.
"""

from __future__ import annotations

import hashlib

from ..sources.transactions import FIXTURE_GAPS_SQL, FIXTURE_TXN_SQL
from ..sources.scores import FIXED_INTERCEPT, FIXTURE_SCORES_SQL, fixed_coefficient

PLACES = 6


def rounded(sql: str, double_cols) -> str:
    """Wrap ``sql`` so the given double columns are rounded like the Spark side."""
    if not double_cols:
        return sql
    rep = ", ".join(f"round({c}, {PLACES}) AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"


TXN_CTE = f"txn AS ({FIXTURE_TXN_SQL})"
SCORES_CTE = f"scores AS ({FIXTURE_SCORES_SQL})"

# --------------------------------------------------------------------------
# Feature derivation
# --------------------------------------------------------------------------
STATS_CTE = """stats AS (
  SELECT avg(transaction_amount) AS amount_mean,
         stddev_pop(transaction_amount) AS amount_std_pop,
         quantile_cont(transaction_amount, 0.2) AS amount_q20,
         quantile_cont(transaction_amount, 0.4) AS amount_q40,
         quantile_cont(transaction_amount, 0.6) AS amount_q60,
         quantile_cont(transaction_amount, 0.8) AS amount_q80,
         quantile_cont(transaction_amount, 0.95) AS amount_q95,
         quantile_cont(CAST(quantity AS DOUBLE), 0.95) AS quantity_q95
  FROM txn)"""

CUST_CTE = """cust AS (
  SELECT customer_id,
         count(DISTINCT transaction_id) AS total_customer_transactions,
         avg(transaction_amount) AS avg_customer_transaction,
         stddev_samp(transaction_amount) AS std_customer_transaction,
         max(transaction_amount) AS max_customer_transaction,
         count(DISTINCT product_category) AS product_category_diversity
  FROM txn WHERE customer_id IS NOT NULL GROUP BY customer_id),
daily AS (
  SELECT customer_id, CAST(transaction_date AS DATE) AS transaction_day,
         count(*) AS daily_count
  FROM txn WHERE customer_id IS NOT NULL AND transaction_date IS NOT NULL
  GROUP BY 1, 2),
vel AS (
  SELECT customer_id, avg(CAST(daily_count AS DOUBLE)) AS avg_daily_transaction_velocity
  FROM daily GROUP BY customer_id)"""

ROW_FEATURES = """
  COALESCE(CAST(t.shipping_address <> t.billing_address AS INTEGER), 1) AS address_mismatch,
  CAST(isodow(t.transaction_date) - 1 AS INTEGER) AS day_of_week,
  CAST(month(t.transaction_date) AS INTEGER) AS month,
  COALESCE(CAST(isodow(t.transaction_date) - 1 >= 5 AS INTEGER), 0) AS is_weekend,
  COALESCE(CAST(t.account_age_days < 30 AS INTEGER), 0) AS new_account,
  ln(1 + t.transaction_amount) AS amount_log,
  t.transaction_amount / (t.quantity + 1) AS amount_per_quantity,
  CASE WHEN t.transaction_hour <= 6 THEN 'Night' WHEN t.transaction_hour <= 12 THEN 'Morning'
       WHEN t.transaction_hour <= 18 THEN 'Afternoon'
       WHEN t.transaction_hour IS NOT NULL THEN 'Evening' END AS hour_bin,
  CASE WHEN t.customer_age <= 0 THEN NULL WHEN t.customer_age <= 25 THEN 'Young'
       WHEN t.customer_age <= 35 THEN 'Young_Adult' WHEN t.customer_age <= 50 THEN 'Adult'
       WHEN t.customer_age <= 65 THEN 'Senior'
       WHEN t.customer_age IS NOT NULL THEN 'Elder' END AS age_category,
  CAST(floor(t.account_age_days / 7) AS BIGINT) AS account_age_weeks,
  ln(1 + CAST(t.quantity AS DOUBLE)) AS quantity_log,
  COALESCE(CAST(t.transaction_hour < 6 OR t.transaction_hour > 22 AS INTEGER), 0) AS unusual_hour_flag"""

STAT_FEATURES = """
  (t.transaction_amount - s.amount_mean) / s.amount_std_pop AS amount_zscore,
  CASE WHEN t.transaction_amount <= s.amount_q20 THEN 'Very_Small'
       WHEN t.transaction_amount <= s.amount_q40 THEN 'Small'
       WHEN t.transaction_amount <= s.amount_q60 THEN 'Medium'
       WHEN t.transaction_amount <= s.amount_q80 THEN 'Large'
       WHEN t.transaction_amount IS NOT NULL THEN 'Very_Large' END AS transaction_size,
  COALESCE(CAST(t.transaction_amount > s.amount_q95 AS INTEGER), 0) AS high_amount_flag,
  COALESCE(CAST(t.quantity > s.quantity_q95 AS INTEGER), 0) AS high_quantity_flag"""

FEATURES_CTE = f"""{STATS_CTE},
{CUST_CTE},
base AS (
  SELECT t.*, {ROW_FEATURES}, {STAT_FEATURES},
    c.total_customer_transactions, c.avg_customer_transaction, c.std_customer_transaction,
    c.max_customer_transaction, c.product_category_diversity, v.avg_daily_transaction_velocity
  FROM txn t CROSS JOIN stats s
  LEFT JOIN cust c ON t.customer_id = c.customer_id
  LEFT JOIN vel v ON t.customer_id = v.customer_id),
hist AS (
  SELECT *,
    CASE WHEN customer_id IS NULL THEN 0.0 ELSE COALESCE(
      CAST(epoch_us(transaction_date) - epoch_us(lag(transaction_date) OVER w) AS DOUBLE) / 3.6e9,
      0.0) END AS time_since_last_transaction,
    CASE WHEN customer_id IS NOT NULL THEN
      avg(transaction_amount) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS _rolling
  FROM base
  WINDOW w AS (PARTITION BY customer_id
               ORDER BY transaction_date ASC NULLS LAST, transaction_id ASC NULLS LAST)),
features AS (
  SELECT * EXCLUDE (_rolling, amount_deviation_from_history),
    transaction_amount * customer_age AS amount_age_interaction,
    transaction_amount * avg_daily_transaction_velocity AS amount_velocity_interaction,
    new_account * high_amount_flag AS new_account_high_value,
    is_weekend * high_amount_flag AS weekend_high_value,
    new_account * high_amount_flag * address_mismatch AS high_risk_profile,
    avg_daily_transaction_velocity * amount_deviation_from_history AS velocity_deviation,
    unusual_hour_flag * high_amount_flag * is_weekend AS suspicious_pattern,
    amount_deviation_from_history
  FROM (SELECT *,
          transaction_amount / (avg_customer_transaction + 1) AS transaction_amount_ratio,
          (transaction_amount - _rolling) / (_rolling + 1) AS amount_deviation_from_history
        FROM hist) h)"""

FEATURE_DOUBLES = [
    "transaction_amount", "amount_log", "amount_per_quantity", "amount_zscore", "quantity_log",
    "avg_customer_transaction", "std_customer_transaction", "max_customer_transaction",
    "transaction_amount_ratio", "time_since_last_transaction", "amount_deviation_from_history",
    "avg_daily_transaction_velocity", "amount_age_interaction", "amount_velocity_interaction",
    "velocity_deviation",
]

SQL: dict[str, str] = {}

SQL["S1_transactions"] = f"WITH {TXN_CTE} SELECT * FROM txn"

SQL["F_row_features"] = rounded(f"""WITH {TXN_CTE}
SELECT t.transaction_id, {ROW_FEATURES} FROM txn t""", ["amount_log", "amount_per_quantity", "quantity_log"])

SQL["A1_global_stats"] = rounded(f"WITH {TXN_CTE}, {STATS_CTE} SELECT * FROM stats",
                                 ["amount_mean", "amount_std_pop", "amount_q20", "amount_q40",
                                  "amount_q60", "amount_q80", "amount_q95", "quantity_q95"])

SQL["F_stat_features"] = rounded(f"""WITH {TXN_CTE}, {STATS_CTE}
SELECT t.transaction_id, {STAT_FEATURES} FROM txn t CROSS JOIN stats s""", ["amount_zscore"])

SQL["A2_A4_customer_aggregates"] = rounded(f"""WITH {TXN_CTE}, {CUST_CTE}
SELECT * FROM cust""", ["avg_customer_transaction", "std_customer_transaction",
                        "max_customer_transaction"])

SQL["A6_daily_counts"] = f"""WITH {TXN_CTE}, {CUST_CTE}
SELECT customer_id, strftime(transaction_day, '%Y-%m-%d') AS transaction_day, daily_count FROM daily"""

SQL["A7_daily_velocity"] = rounded(f"WITH {TXN_CTE}, {CUST_CTE} SELECT * FROM vel",
                                   ["avg_daily_transaction_velocity"])

SQL["W_history_features"] = rounded(f"""WITH {TXN_CTE}, {FEATURES_CTE}
SELECT transaction_id, customer_id, time_since_last_transaction, amount_deviation_from_history
FROM features""", ["time_since_last_transaction", "amount_deviation_from_history"])

SQL["I_interactions"] = rounded(f"""WITH {TXN_CTE}, {FEATURES_CTE}
SELECT transaction_id, amount_age_interaction, amount_velocity_interaction,
       new_account_high_value, weekend_high_value, high_risk_profile, velocity_deviation,
       suspicious_pattern
FROM features""", ["amount_age_interaction", "amount_velocity_interaction", "velocity_deviation"])

SQL["FEATURES_table"] = rounded(f"WITH {TXN_CTE}, {FEATURES_CTE} SELECT * FROM features",
                                FEATURE_DOUBLES)

# --------------------------------------------------------------------------
# Profiling and location leakage
# --------------------------------------------------------------------------
SQL["S2_overview"] = rounded(f"""WITH {TXN_CTE}
SELECT count(*) AS n_rows, CAST(16 AS BIGINT) AS n_columns,
       count(*) FILTER (WHERE is_fraudulent = 1) AS n_positive,
       count(*) FILTER (WHERE is_fraudulent = 0) AS n_negative,
       avg(CAST(is_fraudulent AS DOUBLE)) * 100.0 AS positive_pct
FROM txn""", ["positive_pct"])

SQL["S2_class_counts"] = f"""WITH {TXN_CTE}
SELECT is_fraudulent AS label, count(*) AS n FROM txn GROUP BY 1"""

_NUM_PROFILE = ["transaction_amount", "quantity", "customer_age", "account_age_days",
                "transaction_hour"]
SQL["S3_numeric_profile"] = rounded(f"WITH {TXN_CTE} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean,
       stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min,
       quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25,
       quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50,
       quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max
FROM txn""" for c in _NUM_PROFILE), ["mean", "std", "min", "p25", "p50", "p75", "max"])

SQL["S4_categorical_profile"] = f"WITH {TXN_CTE} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {c} AS level, count(*) AS n FROM txn
WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ["payment_method", "product_category", "device_used"])

RATES_CTE = """rates AS (
  SELECT customer_location, avg(CAST(is_fraudulent AS DOUBLE)) AS fraud_rate, count(*) AS n
  FROM txn WHERE customer_location IS NOT NULL GROUP BY customer_location)"""

SQL["A8_location_rates"] = rounded(f"WITH {TXN_CTE}, {RATES_CTE} SELECT * FROM rates",
                                   ["fraud_rate"])
SQL["T1_top_locations"] = rounded(f"""WITH {TXN_CTE}, {RATES_CTE}
SELECT * FROM rates ORDER BY fraud_rate DESC, customer_location ASC LIMIT 10""", ["fraud_rate"])
SQL["T1_bottom_locations"] = rounded(f"""WITH {TXN_CTE}, {RATES_CTE}
SELECT * FROM rates ORDER BY fraud_rate ASC, customer_location ASC LIMIT 10""", ["fraud_rate"])
SQL["F18_extreme_locations"] = f"""WITH {TXN_CTE}, {RATES_CTE}
SELECT count(*) FILTER (WHERE fraud_rate > 0.9) AS n_extreme_fraud,
       count(*) FILTER (WHERE fraud_rate < 0.1) AS n_extreme_legit FROM rates"""
CORR_SQL = f"""WITH {TXN_CTE}, {RATES_CTE}
SELECT corr(r.fraud_rate, CAST(t.is_fraudulent AS DOUBLE)) AS correlation,
       COALESCE(corr(r.fraud_rate, CAST(t.is_fraudulent AS DOUBLE)) > 0.5, false) AS possible_leak
FROM txn t JOIN rates r ON t.customer_location = r.customer_location"""
SQL["A9_leakage_correlation"] = rounded(CORR_SQL, ["correlation"])
SQL["V13_location_report"] = rounded(f"""WITH {TXN_CTE}, {RATES_CTE},
top AS (SELECT 'top' AS kind, customer_location AS location, fraud_rate AS value FROM rates
        ORDER BY fraud_rate DESC, customer_location LIMIT 10),
bottom AS (SELECT 'bottom' AS kind, customer_location AS location, fraud_rate AS value FROM rates
        ORDER BY fraud_rate ASC, customer_location LIMIT 10),
c AS (SELECT corr(r.fraud_rate, CAST(t.is_fraudulent AS DOUBLE)) AS v
      FROM txn t JOIN rates r ON t.customer_location = r.customer_location)
SELECT * FROM top UNION ALL SELECT * FROM bottom
UNION ALL SELECT 'n_extreme_fraud', CAST(NULL AS VARCHAR), CAST(count(*) FILTER (WHERE fraud_rate > 0.9) AS DOUBLE) FROM rates
UNION ALL SELECT 'n_extreme_legit', CAST(NULL AS VARCHAR), CAST(count(*) FILTER (WHERE fraud_rate < 0.1) AS DOUBLE) FROM rates
UNION ALL SELECT 'correlation', CAST(NULL AS VARCHAR), v FROM c""", ["value"])
SQL["J3_location_lookup"] = rounded(f"""WITH {TXN_CTE}, {RATES_CTE}
SELECT t.customer_location, t.transaction_id, r.fraud_rate
FROM txn t LEFT JOIN rates r ON t.customer_location = r.customer_location""", ["fraud_rate"])

# --------------------------------------------------------------------------
# Preparation, split, scaling, weights
# --------------------------------------------------------------------------
MODEL_NUMERIC = [
    "transaction_amount", "quantity", "customer_age", "account_age_days", "transaction_hour",
    "total_customer_transactions", "address_mismatch", "day_of_week", "month", "is_weekend",
    "new_account", "transaction_amount_ratio", "avg_daily_transaction_velocity",
    "time_since_last_transaction", "amount_deviation_from_history", "product_category_diversity",
    "amount_log", "amount_per_quantity", "amount_zscore", "account_age_weeks", "quantity_log",
    "high_amount_flag", "high_quantity_flag", "unusual_hour_flag", "amount_age_interaction",
    "amount_velocity_interaction", "new_account_high_value", "weekend_high_value",
    "high_risk_profile", "velocity_deviation", "suspicious_pattern"]
MODEL_STRINGS = ["payment_method", "product_category", "device_used", "customer_location"]
MODEL_BINS = ["hour_bin", "age_category", "transaction_size"]
SELECTED_ORDER = ["transaction_amount", "quantity", "customer_age", "account_age_days",
                  "transaction_hour", "total_customer_transactions", "address_mismatch",
                  "day_of_week", "month", "is_weekend", "new_account", "transaction_amount_ratio",
                  "avg_daily_transaction_velocity", "time_since_last_transaction",
                  "amount_deviation_from_history", "product_category_diversity", "amount_log",
                  "amount_per_quantity", "amount_zscore", "hour_bin", "age_category",
                  "account_age_weeks", "transaction_size", "quantity_log", "high_amount_flag",
                  "high_quantity_flag", "unusual_hour_flag", "amount_age_interaction",
                  "amount_velocity_interaction", "new_account_high_value", "weekend_high_value",
                  "high_risk_profile", "velocity_deviation", "suspicious_pattern",
                  "payment_method", "product_category", "device_used", "customer_location"]


def _mode_sql(c, src="features"):
    return (f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} ASC LIMIT 1)")


SQL["A10_median_mode"] = rounded(f"WITH {TXN_CTE}, {FEATURES_CTE} " + " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, median(CAST({c} AS DOUBLE)) AS median, "
     f"CAST(NULL AS VARCHAR) AS mode FROM features" for c in MODEL_NUMERIC]
    + [f"SELECT '{c}', CAST(NULL AS DOUBLE), {_mode_sql(c)}" for c in MODEL_STRINGS]),
    ["median"])

_imp_cols = []
for _c in SELECTED_ORDER:
    if _c in MODEL_NUMERIC:
        _imp_cols.append(f"COALESCE(CAST({_c} AS DOUBLE), "
                         f"(SELECT median(CAST({_c} AS DOUBLE)) FROM features)) AS {_c}")
    elif _c in MODEL_STRINGS:
        _imp_cols.append(f"COALESCE({_c}, {_mode_sql(_c)}) AS {_c}")
    else:
        _imp_cols.append(_c)
IMPUTED_CTE = (f"imputed AS (SELECT transaction_id, is_fraudulent, {', '.join(_imp_cols)} "
               f"FROM features)")
SQL["E1_imputed"] = rounded(f"WITH {TXN_CTE}, {FEATURES_CTE}, {IMPUTED_CTE} SELECT * FROM imputed",
                            MODEL_NUMERIC)

SQL["E2_label_encoding"] = f"""WITH {TXN_CTE}, {FEATURES_CTE}, {IMPUTED_CTE}
SELECT transaction_id, """ + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}_index" for c in MODEL_STRINGS
) + " FROM imputed"

# The fixture's kept one-hot levels (first level dropped).
KEPT_LEVELS = {
    "payment_method": ["bank transfer", "credit card", "debit card"],
    "product_category": ["electronics", "health & beauty", "home & garden", "toys & games"],
    "device_used": ["mobile", "tablet"],
    "hour_bin": ["Morning", "Afternoon", "Evening"],
    "age_category": ["Young_Adult", "Adult", "Senior", "Elder"],
    "transaction_size": ["Small", "Medium", "Large", "Very_Large"],
}


def _dummy(c, lv):
    import re as _re
    return f"{c}_{_re.sub(r'[^0-9a-zA-Z]+', '_', lv).strip('_').lower()}"


DUMMIES = [(_dummy(c, lv), c, lv) for c, lvs in KEPT_LEVELS.items() for lv in lvs]
_dummy_sql = ", ".join(f"COALESCE(CAST({c} = '{lv}' AS INTEGER), 0) AS {d}" for d, c, lv in DUMMIES)
SQL["E3_one_hot"] = f"""WITH {TXN_CTE}, {FEATURES_CTE}, {IMPUTED_CTE}
SELECT transaction_id, {_dummy_sql} FROM imputed"""

_prep_numeric = [c for c in SELECTED_ORDER if c in MODEL_NUMERIC]
PREPARED_CTE = f"""{RATES_CTE.replace('FROM txn', 'FROM features')},
prepared AS (
  SELECT i.transaction_id, i.is_fraudulent, {', '.join('i.' + c for c in _prep_numeric)},
         {_dummy_sql.replace('COALESCE(CAST(', 'COALESCE(CAST(i.')}, r.fraud_rate AS customer_location
  FROM imputed i LEFT JOIN rates r ON i.customer_location = r.customer_location)"""
DESIGN = _prep_numeric + [d for d, _, _ in DUMMIES] + ["customer_location"]

SQL["E4_target_encoding"] = rounded(f"""WITH {TXN_CTE}, {FEATURES_CTE}, {IMPUTED_CTE}, {PREPARED_CTE}
SELECT transaction_id, customer_location FROM prepared""", ["customer_location"])


def _split_cte(src):
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY is_fraudulent
                               ORDER BY md5(transaction_id || '123'), transaction_id) AS _rk
  FROM {src}),
sizes AS (
  SELECT is_fraudulent, n_test, (2 * (n - n_test) * 15 + 85) // 170 AS n_val
  FROM (SELECT is_fraudulent, count(*) AS n, (2 * count(*) * 15 + 100) // 200 AS n_test
        FROM {src} GROUP BY 1)),
splitted AS (
  SELECT r.* EXCLUDE (_rk),
         CASE WHEN r._rk <= s.n_test THEN 'test' WHEN r._rk <= s.n_test + s.n_val THEN 'val'
              ELSE 'train' END AS split
  FROM ranked r JOIN sizes s ON r.is_fraudulent = s.is_fraudulent)"""


IDS_CTE = "ids AS (SELECT transaction_id, is_fraudulent FROM txn)"
SQL["D1_split"] = f"WITH {TXN_CTE}, {IDS_CTE}, {_split_cte('ids')} SELECT * FROM splitted"
SQL["A11_class_balance"] = rounded(f"""WITH {TXN_CTE}, {IDS_CTE}, {_split_cte('ids')}
SELECT split, count(*) FILTER (WHERE is_fraudulent = 1) AS n_positive,
       count(*) FILTER (WHERE is_fraudulent = 0) AS n_negative,
       CAST(count(*) FILTER (WHERE is_fraudulent = 1) AS DOUBLE)
         / CAST(count(*) FILTER (WHERE is_fraudulent = 0) AS DOUBLE) AS minority_ratio,
       count(*) FILTER (WHERE is_fraudulent = 1) * 100.0 / CAST(count(*) AS DOUBLE) AS positive_pct
FROM splitted GROUP BY split""", ["minority_ratio", "positive_pct"])

_fit = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                 for c in DESIGN)
_apply = ", ".join(f"(CAST(p.{c} AS DOUBLE) - f.m_{c}) / "
                   f"(CASE WHEN f.s_{c} = 0 OR f.s_{c} IS NULL THEN 1.0 ELSE f.s_{c} END) AS {c}"
                   for c in DESIGN)
SCALED_CTE = f"""{_split_cte('prepared')},
fit AS (SELECT {_fit} FROM splitted WHERE split = 'train'),
scaled AS (SELECT p.transaction_id, p.split, {_apply} FROM splitted p CROSS JOIN fit f)"""
PIPE = f"WITH {TXN_CTE}, {FEATURES_CTE}, {IMPUTED_CTE}, {PREPARED_CTE}, {SCALED_CTE}"
SQL["D2_standardize"] = rounded(f"{PIPE} SELECT * FROM scaled", DESIGN)
SQL["D3_variance_filter"] = rounded(f"{PIPE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_pop({c}) AS variance, COALESCE(var_pop({c}) > 0.01, false) AS kept "
    f"FROM scaled WHERE split = 'train'" for c in DESIGN), ["variance"])

TRAIN_IDS = f"""WITH {TXN_CTE}, {IDS_CTE}, {_split_cte('ids')},
train AS (SELECT transaction_id, is_fraudulent FROM splitted WHERE split = 'train')"""
SQL["B4_undersample"] = f"""{TRAIN_IDS},
tr AS (SELECT *, row_number() OVER (PARTITION BY is_fraudulent
                                   ORDER BY md5(transaction_id || '123'), transaction_id) AS _rk
       FROM train)
SELECT transaction_id, is_fraudulent FROM tr
WHERE is_fraudulent = 1
   OR _rk <= (SELECT CAST(floor(count(*) / 0.5) AS BIGINT) FROM train WHERE is_fraudulent = 1)"""
SQL["B5_class_weights"] = rounded(f"""{TRAIN_IDS}
SELECT t.transaction_id, t.is_fraudulent,
       CASE WHEN t.is_fraudulent = 1 THEN 50.0 ELSE 1.0 END::DOUBLE AS weight_recall,
       CASE WHEN t.is_fraudulent = 1 THEN 10.0 ELSE 1.0 END::DOUBLE AS weight_precision,
       CAST(n.total AS DOUBLE) / (2 * n.k) AS weight_balanced
FROM train t JOIN (SELECT is_fraudulent, count(*) AS k, sum(count(*)) OVER () AS total
                   FROM train GROUP BY 1) n ON t.is_fraudulent = n.is_fraudulent""",
                                  ["weight_recall", "weight_precision", "weight_balanced"])

# --------------------------------------------------------------------------
# Thresholds, blend and evaluation (naive sweeps, no shortcuts)
# --------------------------------------------------------------------------
SCORES_BASE = f"sbase AS ({FIXTURE_SCORES_SQL})"
ENS_CTE = """ens AS (
  SELECT row_id, label, 'ensemble' AS model,
         CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL
              THEN CAST(0.7 AS DOUBLE) * s1 + CAST(0.3 AS DOUBLE) * s2
              WHEN s1 IS NOT NULL THEN s1 ELSE s2 END AS proba
  FROM (SELECT row_id, label,
               max(proba) FILTER (WHERE model IN ('lr', 'rf')) AS s1,
               avg(proba) FILTER (WHERE model IN ('nn', 'gbt')) AS s2
        FROM sbase GROUP BY row_id, label))"""
GRID_CTE = "grid AS (SELECT CAST(i + 2 AS DOUBLE) / CAST(100 AS DOUBLE) AS threshold FROM range(0, 93) t(i))"


def _sweep(src, beta_expr="CAST(1.0 AS DOUBLE)", fp_cost="1.0", fn_cost="5.0", extra=""):
    """Every grid threshold evaluated by a full pass (the reference's loop)."""
    return f"""sweep AS (
  SELECT s.model, g.threshold {extra},
    count(*) FILTER (WHERE s.label = 1 AND s.proba >= g.threshold) AS tp,
    count(*) FILTER (WHERE s.label = 0 AND s.proba >= g.threshold) AS fp,
    count(*) FILTER (WHERE s.label = 1 AND s.proba < g.threshold) AS fn,
    count(*) FILTER (WHERE s.label = 0 AND s.proba < g.threshold) AS tn
  FROM {src} s CROSS JOIN grid g GROUP BY ALL),
m1 AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
            CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall
  FROM sweep),
met AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN CAST(2.0 AS DOUBLE) * (precision * recall) / (precision + recall) ELSE 0.0 END AS f1,
            CASE WHEN precision + recall > 0 THEN (CAST(1.0 AS DOUBLE) + {beta_expr}) * (precision * recall)
                                                / (({beta_expr} * precision) + recall) ELSE 0.0 END AS f_beta,
            CAST(fp AS DOUBLE) * {fp_cost} + CAST(fn AS DOUBLE) * {fn_cost} AS total_cost
  FROM m1)"""


_MET_COLS = "model, threshold, tp, fp, fn, tn, precision, recall, f1, f_beta, total_cost"
_MET_DOUBLES = ["threshold", "precision", "recall", "f1", "f_beta", "total_cost"]
_BEST_FBETA = ("ORDER BY (f_beta > 0) DESC, f_beta DESC, (threshold = 0.5) DESC, threshold ASC")

SQL["L6_threshold_search"] = rounded(f"""WITH {TXN_CTE}, {SCORES_BASE}, {GRID_CTE}, {_sweep('sbase')}
SELECT {_MET_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY model {_BEST_FBETA}) AS rk FROM met)
WHERE rk = 1""", _MET_DOUBLES)
SQL["L6_threshold_cost"] = rounded(f"""WITH {TXN_CTE}, {SCORES_BASE}, {GRID_CTE}, {_sweep('sbase')}
SELECT {_MET_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY model
                                   ORDER BY total_cost ASC, threshold ASC) AS rk FROM met)
WHERE rk = 1""", _MET_DOUBLES)
SQL["L6_threshold_table"] = rounded(f"""WITH {TXN_CTE}, {SCORES_BASE}, {GRID_CTE},
{_sweep('sbase', beta_expr='CAST(4.0 AS DOUBLE)')}
SELECT {_MET_COLS} FROM met""", _MET_DOUBLES)

PROFILE_CTE = """prof(model, beta, cost_fp, cost_fn) AS (VALUES
  ('lr', 5.0::DOUBLE, 1.0::DOUBLE, 50.0::DOUBLE), ('rf', 5.0::DOUBLE, 1.0::DOUBLE, 50.0::DOUBLE),
  ('nn', 0.5::DOUBLE, 50.0::DOUBLE, 1.0::DOUBLE), ('gbt', 0.5::DOUBLE, 50.0::DOUBLE, 1.0::DOUBLE),
  ('ensemble', 2.0::DOUBLE, 5.0::DOUBLE, 20.0::DOUBLE))"""
EVAL_CTE = f"""{TXN_CTE}, {IDS_CTE}, {_split_cte('ids')}, {SCORES_BASE}, {ENS_CTE},
allm AS (SELECT * FROM sbase UNION ALL SELECT * FROM ens),
es AS (SELECT a.*, sp.split FROM allm a JOIN splitted sp ON a.row_id = sp.transaction_id),
val AS (SELECT e.row_id, e.label, e.model, e.proba, p.beta, p.cost_fp, p.cost_fn
        FROM es e JOIN prof p ON e.model = p.model WHERE e.split = 'val'),
{GRID_CTE},
{_sweep('val', beta_expr='(beta * beta)', fp_cost='cost_fp', fn_cost='cost_fn', extra=', s.beta, s.cost_fp, s.cost_fn')},
thr AS (SELECT model, beta, threshold, tp, fp, fn, tn, precision, recall, f1, f_beta, total_cost
        FROM (SELECT *, row_number() OVER (PARTITION BY model {_BEST_FBETA}) AS rk FROM met) WHERE rk = 1),
test AS (SELECT row_id, label, model, proba FROM es WHERE split = 'test'),
pred AS (SELECT t.*, COALESCE(h.threshold, 0.5) AS threshold,
                CAST(t.proba >= COALESCE(h.threshold, 0.5) AS INTEGER) AS pred
         FROM test t LEFT JOIN thr h ON t.model = h.model),
cc AS (SELECT model, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
              count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn,
              count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM pred GROUP BY model),
dist AS (SELECT model, proba, count(*) FILTER (WHERE label = 1) AS pos,
                count(*) FILTER (WHERE label = 0) AS neg FROM test GROUP BY model, proba),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY proba) AS cum_pos,
               sum(neg) OVER (PARTITION BY model ORDER BY proba) AS cum_neg,
               sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
        FROM dist),
auc AS (SELECT model, CASE WHEN 2.0 * max(P) * max(N) > 0 THEN
          CAST(sum(pos * (2 * (cum_neg - neg) + neg)) AS DOUBLE) / (CAST(2.0 AS DOUBLE) * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE))
          END AS auc FROM cum GROUP BY model),
v1 AS (SELECT c.model,
  CASE WHEN tp + fp + fn + tn > 0 THEN CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1,
  CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN CAST(5 * tp AS DOUBLE) / CAST(5 * tp + 4 * fn + fp AS DOUBLE) ELSE 0.0 END AS f2,
  a.auc
  FROM cc c LEFT JOIN auc a ON c.model = a.model)"""
EVAL = f"WITH {PROFILE_CTE}, {EVAL_CTE}"

SQL["L7_threshold_profiles"] = rounded(f"{EVAL} SELECT * FROM thr", _MET_DOUBLES + ["beta"])
SQL["L8_blend"] = rounded(f"WITH {TXN_CTE}, {SCORES_BASE}, {ENS_CTE} SELECT * FROM ens", ["proba"])
SQL["L9_stage_counts"] = rounded(f"""{EVAL}
SELECT v.model, h.threshold, count(*) FILTER (WHERE v.proba >= h.threshold) AS n_flagged
FROM val v JOIN thr h ON v.model = h.model WHERE v.model <> 'ensemble' GROUP BY v.model, h.threshold
UNION ALL
SELECT 'stage1', CAST(0.5 AS DOUBLE), count(*) FILTER (WHERE s1 >= 0.5)
FROM (SELECT row_id, max(proba) FILTER (WHERE model IN ('lr', 'rf')) AS s1
      FROM val WHERE model <> 'ensemble' GROUP BY row_id)""", ["threshold"])
SQL["L10_focal_loss"] = rounded(f"""WITH {TXN_CTE}, {SCORES_BASE},
c AS (SELECT model, CAST(label AS DOUBLE) AS y,
             least(greatest(proba, CAST(1e-7 AS DOUBLE)), CAST(1.0 AS DOUBLE) - CAST(1e-7 AS DOUBLE)) AS p FROM sbase),
b AS (SELECT model, -(y * ln(p) + (1.0 - y) * ln(1.0 - p)) AS bce FROM c)
SELECT model, avg(0.25 * pow(1.0 - exp(-bce), 2.0) * bce) AS focal_loss FROM b GROUP BY model""",
                                ["focal_loss"])
# The thresholds from one histogram: a score's grid place is the number of grid values up to it.
SQL["L11_batch_scoring"] = rounded(f"""WITH {PROFILE_CTE}, {TXN_CTE}, {IDS_CTE}, {_split_cte('ids')}, {SCORES_BASE}, {ENS_CTE},
es AS MATERIALIZED (SELECT a.row_id, a.label, a.model, a.proba, sp.split
                    FROM (SELECT * FROM sbase UNION ALL SELECT * FROM ens) a JOIN splitted sp ON a.row_id = sp.transaction_id),
near AS (SELECT model, label, proba, least(greatest(CAST(floor(proba * 100) AS INTEGER), 1), 94) AS c FROM es WHERE split = 'val'),
placed AS (SELECT model, label, c + CASE WHEN c < 94 AND proba >= CAST(c + 1 AS DOUBLE) / CAST(100 AS DOUBLE) THEN 1
                                         WHEN c > 1 AND proba < CAST(c AS DOUBLE) / CAST(100 AS DOUBLE) THEN -1 ELSE 0 END AS c FROM near),
hist AS (SELECT model, c, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM placed GROUP BY ALL),
steps AS (SELECT model, t.c, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg
          FROM (SELECT model, unnest(range(1, 95)) AS c FROM (SELECT DISTINCT model FROM placed)) t LEFT JOIN hist USING (model, c)),
sweep AS (SELECT model, c, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp, sum(pos) OVER (PARTITION BY model) AS p
          FROM steps WINDOW up AS (PARTITION BY model ORDER BY c DESC)),
m1 AS (SELECT s.model, CAST(c AS DOUBLE) / CAST(100 AS DOUBLE) AS threshold, beta,
              CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
              CASE WHEN p > 0 THEN CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) ELSE 0.0 END AS recall
       FROM sweep s JOIN prof USING (model) WHERE c >= 2),
met AS (SELECT model, threshold, CASE WHEN precision + recall > 0 THEN (CAST(1.0 AS DOUBLE) + (beta * beta)) * (precision * recall)
                                                                   / (((beta * beta) * precision) + recall) ELSE 0.0 END AS f_beta FROM m1),
thr AS MATERIALIZED (SELECT model, threshold FROM (SELECT *, row_number() OVER (PARTITION BY model {_BEST_FBETA}) AS rk FROM met) WHERE rk = 1)
SELECT row_id, label, model, proba, COALESCE(threshold, 0.5) AS threshold, CAST(proba >= COALESCE(threshold, 0.5) AS INTEGER) AS pred
FROM es LEFT JOIN thr USING (model) WHERE split = 'test'""", ["proba", "threshold"])
V1_DOUBLES = ["accuracy", "precision", "recall", "f1", "f2", "auc"]
SQL["V1_metrics"] = rounded(f"{EVAL} SELECT * FROM v1", V1_DOUBLES)
SQL["V2_confusion"] = f"""{EVAL},
grid4 AS (SELECT DISTINCT p.model, g.label, g.pred FROM pred p
          CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(label, pred))
SELECT g.model, g.label, g.pred, COALESCE(c.n, 0) AS n
FROM grid4 g LEFT JOIN (SELECT model, label, pred, count(*) AS n FROM pred GROUP BY ALL) c
  ON g.model = c.model AND g.label = c.label AND g.pred = c.pred"""


def _r(num, den):
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END"


_p1, _r1, _p0, _r0 = _r("tp", "tp + fp"), _r("tp", "tp + fn"), _r("tn", "tn + fn"), _r("tn", "tn + fp")
_f11, _f10 = _r("2 * tp", "2 * tp + fp + fn"), _r("2 * tn", "2 * tn + fn + fp")
_n = "(tp + fp + fn + tn)"


def _w(a, b):
    return (f"CASE WHEN {_n} > 0 THEN (({a}) * CAST(tn + fp AS DOUBLE) + ({b}) * CAST(tp + fn AS DOUBLE))"
            f" / CAST({_n} AS DOUBLE) ELSE 0.0 END")


SQL["V3_classification_report"] = rounded(f"""{EVAL}
SELECT model, 'Legitimate' AS row_name, {_p0} AS precision, {_r0} AS recall, {_f10} AS f1_score, tn + fp AS support FROM cc
UNION ALL SELECT model, 'Fraudulent', {_p1}, {_r1}, {_f11}, tp + fn FROM cc
UNION ALL SELECT model, 'accuracy', NULL, NULL, {_r('tp + tn', _n)}, {_n} FROM cc
UNION ALL SELECT model, 'macro avg', ({_p0} + {_p1}) / 2.0, ({_r0} + {_r1}) / 2.0, ({_f10} + {_f11}) / 2.0, {_n} FROM cc
UNION ALL SELECT model, 'weighted avg', {_w(_p0, _p1)}, {_w(_r0, _r1)}, {_w(_f10, _f11)}, {_n} FROM cc""",
                                          ["precision", "recall", "f1_score"])
SQL["V4_roc_curve"] = rounded(f"""{EVAL}
SELECT model, proba AS threshold,
       CAST(N - cum_neg + neg AS DOUBLE) / CAST(N AS DOUBLE) AS fpr,
       CAST(P - cum_pos + pos AS DOUBLE) / CAST(P AS DOUBLE) AS tpr FROM cum
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM cum""", ["threshold", "fpr", "tpr"])
SQL["V4_auc"] = rounded(f"{EVAL} SELECT * FROM auc", ["auc"])
SQL["V5_pr_curve"] = rounded(f"""{EVAL}
SELECT model, proba AS threshold,
       CASE WHEN (P - cum_pos + pos) + (N - cum_neg + neg) > 0
            THEN CAST(P - cum_pos + pos AS DOUBLE) / CAST((P - cum_pos + pos) + (N - cum_neg + neg) AS DOUBLE)
            ELSE 0.0 END AS precision,
       CASE WHEN P > 0 THEN CAST(P - cum_pos + pos AS DOUBLE) / CAST(P AS DOUBLE) ELSE 1.0 END AS recall
FROM cum
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM cum""", ["threshold", "precision", "recall"])
SQL["V6_metric_comparison"] = rounded(f"""{EVAL}
SELECT model, metric, value FROM v1 UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, f2, auc))""",
                                      ["value"])
SQL["V11_error_slices"] = rounded(f"""WITH {PROFILE_CTE}, {EVAL_CTE}, {FEATURES_CTE},
lr AS (SELECT customer_location, avg(CAST(is_fraudulent AS DOUBLE)) AS rate FROM txn
       WHERE customer_location IS NOT NULL GROUP BY 1),
med AS (SELECT median(transaction_amount) AS m FROM txn),
x AS (SELECT p.model, p.label, f.*, lr.rate FROM pred p
      LEFT JOIN features f ON p.row_id = f.transaction_id
      LEFT JOIN lr ON f.customer_location = lr.customer_location
      WHERE p.label <> p.pred),
s AS (SELECT model, CASE WHEN label = 1 THEN 'false_negative' ELSE 'false_positive' END AS error_kind,
  CASE WHEN label = 1 THEN (CASE
      WHEN account_age_days > 90 THEN 'established_account'
      WHEN transaction_amount < (SELECT m FROM med) THEN 'small_amount'
      WHEN rate < 0.03 THEN 'low_risk_location'
      WHEN transaction_hour BETWEEN 9 AND 21 AND day_of_week < 5 THEN 'typical_hours'
      ELSE 'other' END)
  ELSE (CASE
      WHEN new_account = 1 AND high_amount_flag = 1 THEN 'new_account_high_value'
      WHEN address_mismatch = 1 THEN 'address_mismatch'
      WHEN amount_deviation_from_history > 1.0 OR velocity_deviation > 1.0 THEN 'unusual_pattern'
      WHEN weekend_high_value = 1 THEN 'weekend_high_value'
      WHEN rate > 0.1 THEN 'high_risk_location'
      ELSE 'other' END) END AS slice
  FROM x)
SELECT model, error_kind, slice, count(*) AS n,
       CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY model, error_kind) AS DOUBLE) AS share
FROM s GROUP BY model, error_kind, slice""", ["share"])

# --------------------------------------------------------------------------
# K1 brute force over the scaled training positives; S5 equals the feature table
# --------------------------------------------------------------------------
_dist = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DESIGN)
SQL["K1_knn_minority"] = rounded(f"""{PIPE},
pos AS (SELECT s.* FROM scaled s JOIN splitted p ON s.transaction_id = p.transaction_id
        WHERE s.split = 'train' AND p.is_fraudulent = 1),
pairs AS (SELECT a.transaction_id AS query_id, b.transaction_id AS neighbor_id, sqrt({_dist}) AS distance
          FROM pos a JOIN pos b ON a.transaction_id <> b.transaction_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, neighbor_id, CAST(rank AS BIGINT) AS rank, distance FROM r WHERE rank <= 5""", ["distance"])
SQL["S5_parquet_roundtrip"] = SQL["FEATURES_table"]

_FN_SLICES = [("established_account", "account_age_days > 90"),
              ("small_amount", "transaction_amount < (SELECT m FROM med)"),
              ("low_risk_location", "rate < 0.03"),
              ("typical_hours", "transaction_hour BETWEEN 9 AND 21 AND day_of_week < 5")]
_FP_SLICES = [("new_account_high_value", "new_account = 1 AND high_amount_flag = 1"),
              ("address_mismatch", "address_mismatch = 1"),
              ("unusual_pattern", "amount_deviation_from_history > 1.0 OR velocity_deviation > 1.0"),
              ("weekend_high_value", "weekend_high_value = 1"),
              ("high_risk_location", "rate > 0.1")]
_ov = " UNION ALL ".join(
    [f"SELECT model, 'false_negative' AS error_kind, '{n}' AS slice FROM x WHERE label = 1 AND ({c})"
     for n, c in _FN_SLICES]
    + [f"SELECT model, 'false_positive', '{n}' FROM x WHERE label = 0 AND ({c})" for n, c in _FP_SLICES])
SQL["V11_error_slices_overlapping"] = rounded(f"""WITH {PROFILE_CTE}, {EVAL_CTE}, {FEATURES_CTE},
lr AS (SELECT customer_location, avg(CAST(is_fraudulent AS DOUBLE)) AS rate FROM txn
       WHERE customer_location IS NOT NULL GROUP BY 1),
med AS (SELECT median(transaction_amount) AS m FROM txn),
x AS (SELECT p.model, p.label, f.*, lr.rate FROM pred p
      LEFT JOIN features f ON p.row_id = f.transaction_id
      LEFT JOIN lr ON f.customer_location = lr.customer_location
      WHERE p.label <> p.pred),
tot AS (SELECT model, CASE WHEN label = 1 THEN 'false_negative' ELSE 'false_positive' END AS error_kind,
               count(*) AS total FROM x GROUP BY 1, 2),
s AS ({_ov})
SELECT s.model, s.error_kind, s.slice, count(*) AS n,
       CAST(count(*) AS DOUBLE) / CAST(max(t.total) AS DOUBLE) AS share
FROM s JOIN tot t ON s.model = t.model AND s.error_kind = t.error_kind
GROUP BY s.model, s.error_kind, s.slice""", ["share"])

# Leak-free customer aggregates (each row sees its customer's rows up to itself)
PAST_CTE = """past_ids AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY customer_id, transaction_id
                       ORDER BY transaction_date ASC NULLS LAST, transaction_id ASC NULLS LAST) = 1
                     THEN 1 ELSE 0 END AS first_id,
             CAST(transaction_date AS DATE) AS d
      FROM txn WHERE customer_id IS NOT NULL),
past_days AS (SELECT *, CASE WHEN d IS NULL THEN 0
                     WHEN (lag(d) OVER (PARTITION BY customer_id ORDER BY transaction_date ASC NULLS LAST,
                                        transaction_id ASC NULLS LAST)) IS DISTINCT FROM d THEN 1
                     ELSE 0 END AS new_day
      FROM past_ids),
past AS (SELECT transaction_id,
  CAST(sum(first_id) OVER r AS BIGINT) AS past_total_customer_transactions,
  CAST(sum(CAST(transaction_amount AS DECIMAL(38,10))) OVER r AS DOUBLE)
    / CAST(count(transaction_amount) OVER r AS DOUBLE) AS past_avg_customer_transaction,
  stddev_samp(transaction_amount) OVER r AS past_std_customer_transaction,
  max(transaction_amount) OVER r AS past_max_customer_transaction,
  CAST(len(list_distinct(list(product_category) OVER r)) AS BIGINT) AS past_product_category_diversity,
  CAST(count(transaction_date) OVER r AS DOUBLE) / CAST(sum(new_day) OVER r AS DOUBLE)
    AS past_avg_daily_transaction_velocity
FROM past_days
WINDOW r AS (PARTITION BY customer_id ORDER BY transaction_date ASC NULLS LAST,
             transaction_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SQL["W_past_customer_features"] = rounded(f"WITH {TXN_CTE}, {PAST_CTE} SELECT * FROM past",
    ["past_avg_customer_transaction", "past_std_customer_transaction",
     "past_max_customer_transaction", "past_avg_daily_transaction_velocity"])

# --------------------------------------------------------------------------
# The fixture with gaps and a large customer
# --------------------------------------------------------------------------
GAPS_CTE = f"txn AS ({FIXTURE_GAPS_SQL})"
SQL["W_history_split"] = rounded(f"""WITH {GAPS_CTE}, {FEATURES_CTE}
SELECT transaction_id, customer_id, time_since_last_transaction, amount_deviation_from_history, total_customer_transactions,
       avg_customer_transaction, std_customer_transaction, max_customer_transaction, product_category_diversity, avg_daily_transaction_velocity
FROM features""", ["time_since_last_transaction", "amount_deviation_from_history", "avg_customer_transaction", "std_customer_transaction",
                   "max_customer_transaction", "avg_daily_transaction_velocity"])
SQL["W_past_split"] = SQL["W_past_customer_features"].replace(TXN_CTE, GAPS_CTE)
SQL["E1_imputed_gaps"] = SQL["E1_imputed"].replace(TXN_CTE, GAPS_CTE)
SQL["F1_csv_scan"] = SQL["S1_transactions"]
SQL["V4_roc_curve_pruned"] = rounded(f"""{EVAL},
steps AS (SELECT *, lag(pos) OVER up AS below_pos, lag(neg) OVER up AS below_neg, lead(proba) OVER up AS above FROM cum
          WINDOW up AS (PARTITION BY model ORDER BY proba))
SELECT model, proba AS threshold, CAST(N - cum_neg + neg AS DOUBLE) / CAST(N AS DOUBLE) AS fpr, CAST(P - cum_pos + pos AS DOUBLE) / CAST(P AS DOUBLE) AS tpr
FROM steps WHERE above IS NULL OR below_pos IS NULL OR below_pos <> pos OR below_neg <> neg
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM cum""", ["threshold", "fpr", "tpr"])

# --------------------------------------------------------------------------
# Folds; a linear scorer of fixed coefficients and its explanations
# --------------------------------------------------------------------------
SQL["L5_folds"] = f"""{TRAIN_IDS}
SELECT transaction_id AS row_id, CAST(is_fraudulent AS DOUBLE) AS label,
       CAST((row_number() OVER (PARTITION BY is_fraudulent ORDER BY md5(transaction_id || '123'), transaction_id) - 1) % 5 AS INTEGER) AS fold
FROM train"""

_margin = " + ".join([f"CAST({FIXED_INTERCEPT} AS DOUBLE)"] + [f"CAST({fixed_coefficient(c)} AS DOUBLE) * s.{c}" for c in DESIGN])
_moments = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in DESIGN)
FIXED = f"""{PIPE.replace('scaled AS (', 'scaled AS MATERIALIZED (')},
moments AS MATERIALIZED (SELECT {_moments} FROM scaled WHERE split = 'train'),
test AS MATERIALIZED (SELECT s.*, p.is_fraudulent AS y, {_margin} AS margin,
                             row_number() OVER (ORDER BY md5(s.transaction_id || '123'), s.transaction_id) AS rk, count(*) OVER () AS n
                      FROM scaled s JOIN splitted p USING (transaction_id) WHERE s.split = 'test')"""
SQL["L1_fixed_scores"] = rounded(f"""{FIXED}
SELECT transaction_id AS row_id, y AS label, 'fixed' AS model, 1 / (1 + exp(-margin)) AS proba FROM test""", ["proba"])

FIXED_SHAP = f"""{FIXED}, shap AS ({' UNION ALL '.join(
    f"SELECT transaction_id AS row_id, '{c}' AS feature, CAST({fixed_coefficient(c)} AS DOUBLE) * ({c} - m_{c}) AS shap FROM test, moments WHERE v_{c} > 0.01"
    for c in DESIGN)})"""
SQL["V9_fixed_shapley"] = rounded(f"{FIXED_SHAP} SELECT * FROM shap", ["shap"])
SQL["V10_fixed_attribution"] = rounded(f"""{FIXED_SHAP}
SELECT feature, avg(abs(shap)) AS mean_abs_shap FROM shap GROUP BY feature ORDER BY mean_abs_shap DESC, feature LIMIT 20""", ["mean_abs_shap"])


def _shift(c: str) -> int:
    return int(hashlib.md5(f"{c}123".encode()).hexdigest()[:8], 16)


_said = {c: f"(a.margin + CAST({fixed_coefficient(c)} AS DOUBLE) * (b.{c} - a.{c})) > 0" for c in DESIGN}
_counted = "count(*) FILTER (y = 1 AND said) AS tp, count(*) FILTER (y = 0 AND said) AS fp, count(*) FILTER (y = 1 AND NOT said) AS fn, count(*) AS n"
_permuted = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {_counted} FROM (SELECT a.y, {_said[c]} AS said
        FROM test a JOIN test b ON b.rk = (a.rk - 1 + {_shift(c)} % greatest(a.n - 1, 1) + 1) % a.n + 1, moments WHERE v_{c} > 0.01) HAVING count(*) > 0"""
    for c in DESIGN)


def _importance(value: str) -> str:
    return f"""{FIXED}, permuted AS ({_permuted}),
unpermuted AS (SELECT {value} AS m FROM (SELECT {_counted} FROM (SELECT y, margin > 0 AS said FROM test))),
drops AS (SELECT feature, m - {value} AS gap FROM permuted, unpermuted),
importances AS (SELECT feature, CASE WHEN (SELECT sum(gap) FROM drops) <> 0 THEN gap / (SELECT sum(gap) FROM drops) ELSE 0.0 END AS importance FROM drops)"""


_accuracy = "(CAST(n - fp - fn AS DOUBLE) / n)"
_f1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END"
SQL["V8_fixed_importance"] = rounded(f"{_importance(_accuracy)} SELECT * FROM importances", ["importance"])
SQL["V8_fixed_importance_f1"] = rounded(f"{_importance(_f1)} SELECT * FROM importances", ["importance"])
SQL["T2_top_importances"] = rounded(f"{_importance(_accuracy)} SELECT * FROM importances ORDER BY abs(importance) DESC, feature LIMIT 15", ["importance"])
SQL["V9_local_accuracy"] = f"""WITH {TXN_CTE}, {IDS_CTE}, {_split_cte('ids')}
SELECT transaction_id AS row_id, true AS adds_up FROM splitted WHERE split = 'test'"""

# --------------------------------------------------------------------------
# Brute-force neighbours, then the hashed draws
# --------------------------------------------------------------------------
_sum = lambda t: " + ".join(["CAST(0 AS DOUBLE)"] + [t.replace("?", c) for c in DESIGN])


def _drawn(k: int, draws: str) -> str:
    """synthetic rows: `draws` gives (id, n) of the minority rows."""
    return f"""near AS MATERIALIZED (
  SELECT a.transaction_id AS id, b.transaction_id AS nid,
         row_number() OVER (PARTITION BY a.transaction_id ORDER BY sqrt({_dist}), b.transaction_id) AS rank
  FROM pos a JOIN pos b ON a.transaction_id <> b.transaction_id QUALIFY rank <= {k}),
draws AS ({draws}),
each AS (SELECT id, unnest(range(0, n)) AS d FROM draws WHERE n > 0),
picked AS (
  SELECT e.id, e.d, CAST('0x' || substr(md5(e.id || '|' || e.d || '|123|nn'), 1, 8) AS BIGINT) % (SELECT max(rank) FROM near m WHERE m.id = e.id) + 1 AS rank,
         CAST(CAST('0x' || substr(md5(e.id || '|' || e.d || '|123|u'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM each e),
synthetic AS (
  SELECT 'syn-' || k.id || '-' || k.d AS row_id, 1 AS label, 1 AS synthetic, {_sum('(a.? + k.u * (b.? - a.?))')} AS feature_sum
  FROM picked k JOIN near m ON m.id = k.id AND m.rank = k.rank JOIN pos a ON a.transaction_id = k.id JOIN pos b ON b.transaction_id = m.nid)"""


BALANCE = f"""{PIPE.replace('scaled AS (', 'scaled AS MATERIALIZED (')},
train AS MATERIALIZED (SELECT s.*, p.is_fraudulent AS y FROM scaled s JOIN splitted p USING (transaction_id) WHERE s.split = 'train'),
pos AS MATERIALIZED (SELECT * FROM train WHERE y = 1),
sizes2 AS (SELECT count(*) FILTER (y = 1) AS n_min, count(*) FILTER (y = 0) AS n_maj FROM train),
originals AS (SELECT transaction_id AS row_id, y AS label, 0 AS synthetic, {_sum('?')} AS feature_sum FROM train)"""


def _even(goal: str) -> str:
    return f"""SELECT transaction_id AS id, g // n_min + CASE WHEN row_number() OVER (ORDER BY md5(transaction_id || '123'), transaction_id) <= g % n_min THEN 1 ELSE 0 END AS n
FROM pos, (SELECT n_min, greatest({goal} - n_min, 0) AS g FROM sizes2)"""


SQL["B1_smote"] = rounded(f"""{BALANCE}, {_drawn(5, _even('n_maj'))}
SELECT * FROM originals UNION ALL SELECT * FROM synthetic""", ["feature_sum"])
_hard = f"""SELECT id, CAST(round(CAST(r AS DOUBLE) * (n_maj - n_min) / CAST((SELECT sum(r) FROM hard) AS DOUBLE)) AS BIGINT) AS n FROM hard, sizes2"""
SQL["B2_adasyn"] = rounded(f"""{BALANCE},
hard AS MATERIALIZED (SELECT id, count(*) FILTER (y = 0) AS r FROM (
  SELECT a.transaction_id AS id, b.y FROM pos a JOIN train b ON a.transaction_id <> b.transaction_id
  QUALIFY row_number() OVER (PARTITION BY a.transaction_id ORDER BY sqrt({_dist}), b.transaction_id) <= 10) GROUP BY id),
{_drawn(10, _hard)}
SELECT * FROM originals UNION ALL SELECT * FROM synthetic""", ["feature_sum"])
SQL["B3_hybrid"] = rounded(f"""{BALANCE}, {_drawn(5, _even('CAST(floor(0.3::DOUBLE * n_maj) AS BIGINT)'))},
both_kinds AS (SELECT * FROM originals UNION ALL SELECT * FROM synthetic),
numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '123'), row_id) AS rk FROM both_kinds)
SELECT row_id, label, synthetic, feature_sum FROM numbered
WHERE label = 1 OR rk <= (SELECT CAST(floor(count(*) / 0.5) AS BIGINT) FROM both_kinds WHERE label = 1)""", ["feature_sum"])

# --------------------------------------------------------------------------
# The leak-free design: statistics, fills, rates and scales of the training rows, customers as of each row
# --------------------------------------------------------------------------
_parts = _split_cte("ids").replace("ranked", "ranked_ids").replace("sizes", "sizes_ids").replace("splitted", "splitted_ids")
TRAIN_FEATURES = (FEATURES_CTE
                  .replace("FROM txn)", "FROM txn JOIN parts USING (transaction_id) WHERE split = 'train')", 1)
                  .replace(f"{CUST_CTE},\n", "")
                  .replace(", ".join(["c.total_customer_transactions", "c.avg_customer_transaction", "c.std_customer_transaction"]),
                           ", ".join(f"c.past_{n} AS {n}" for n in ("total_customer_transactions", "avg_customer_transaction", "std_customer_transaction")))
                  .replace("c.max_customer_transaction, c.product_category_diversity, v.avg_daily_transaction_velocity",
                           ", ".join(f"c.past_{n} AS {n}" for n in ("max_customer_transaction", "product_category_diversity", "avg_daily_transaction_velocity")))
                  .replace("LEFT JOIN cust c ON t.customer_id = c.customer_id\n  LEFT JOIN vel v ON t.customer_id = v.customer_id",
                           "LEFT JOIN past c ON t.transaction_id = c.transaction_id"))
_train_fills = ", ".join(
    f"COALESCE(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM train_features)) AS {c}" if c in MODEL_NUMERIC
    else f"COALESCE({c}, {_mode_sql(c, 'train_features')}) AS {c}" if c in MODEL_STRINGS else c for c in SELECTED_ORDER)
TRAIN_PREPARED = f"""train_features AS (SELECT f.* FROM features f JOIN parts USING (transaction_id) WHERE split = 'train'),
imputed AS (SELECT transaction_id, is_fraudulent, {_train_fills} FROM features),
rates AS (SELECT customer_location, avg(CAST(is_fraudulent AS DOUBLE)) AS fraud_rate FROM train_features WHERE customer_location IS NOT NULL GROUP BY 1),
prepared AS (
  SELECT i.transaction_id, i.is_fraudulent, {', '.join('i.' + c for c in _prep_numeric)},
         {_dummy_sql.replace('COALESCE(CAST(', 'COALESCE(CAST(i.')},
         COALESCE(r.fraud_rate, (SELECT avg(CAST(is_fraudulent AS DOUBLE)) FROM train_features)) AS customer_location
  FROM imputed i LEFT JOIN rates r ON i.customer_location = r.customer_location)"""
_train_margin = " + ".join([f"CAST({FIXED_INTERCEPT} AS DOUBLE)"] + [f"CAST({fixed_coefficient(c)} AS DOUBLE) * {c}" for c in DESIGN])
SQL["D2_train_design"] = rounded(f"""WITH {GAPS_CTE}, {IDS_CTE}, {_parts}, parts AS (SELECT transaction_id, split FROM splitted_ids), {PAST_CTE},
{TRAIN_FEATURES}, {TRAIN_PREPARED}, {SCALED_CTE}
SELECT transaction_id AS row_id, split, {_train_margin} AS margin FROM scaled""", ["margin"])
