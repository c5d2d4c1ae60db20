"""DuckDB statements that give the same rows as the registered queries.

All statements start from the given tables only. ``_BASE`` derives the retail
tables once; each statement below is put behind it.
"""

from __future__ import annotations

import re

from shelfline import schemas as S
from shelfline.plans.batches import BATCHES
from shelfline.plans.catalog import FREQUENCY_STEPS, LATER, MUCH_LATER, VALUE_STEPS
from shelfline.sources.tables import AS_OF, CITIES

_BASE = """
WITH cities AS (
  SELECT n_nationkey, n_regionkey,
         CASE WHEN n_nationkey >= 20 THEN n_name ELSE
           ([__CITIES__])[CAST(n_nationkey % 10 AS INTEGER) + 1]
         END AS city
  FROM nation),
customers AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name,
         'user' || CAST(c_custkey AS VARCHAR) || '@mail' || CAST(c_nationkey AS VARCHAR) || '.example.com' AS email,
         CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE '+91-' || CAST(c_custkey + 9000000000 AS VARCHAR) END AS phone,
         city, c_acctbal AS balance
  FROM customer JOIN cities ON c_nationkey = n_nationkey),
moved AS (
  SELECT customer_id, name, email, phone,
         CASE WHEN right(customer_id, 1) = '3' THEN 'Pune' ELSE city END AS city
  FROM customers),
lines AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
         CASE WHEN l_orderkey % 300 = 11 THEN o_orderdate + INTERVAL 3650 DAY ELSE o_orderdate END AS date,
         'S' || CAST(l_suppkey AS VARCHAR) AS store_id,
         CASE WHEN l_orderkey % 100 <> 7 THEN 'C' || CAST(o_custkey AS VARCHAR) END AS customer_id,
         CASE WHEN l_orderkey % 500 <> 9 THEN 'P' || CAST(l_partkey AS VARCHAR) END AS product_id,
         CASE WHEN l_orderkey % 250 = 3 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
         CAST(CASE WHEN l_orderkey % 200 = 0 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS price,
         CASE WHEN l_discount <> 0 THEN
           CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,4)) END AS discount,
         o_orderpriority AS payment_method
  FROM lines),
uniq AS (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY transaction_id
    ORDER BY product_id NULLS LAST, store_id NULLS LAST, quantity NULLS LAST, price NULLS LAST, discount NULLS LAST) = 1),
cleaned AS (
  SELECT transaction_id, date, store_id, customer_id, product_id, quantity, abs(price) AS price,
         coalesce(discount, 0) AS discount, payment_method
  FROM uniq
  WHERE transaction_id IS NOT NULL AND product_id IS NOT NULL AND store_id IS NOT NULL
    AND quantity > 0 AND date <= TIMESTAMP '2002-01-01'),
dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS date,
         CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
         dayofweek(d) IN (0, 6) AS is_weekend, FALSE AS is_holiday, CAST(NULL AS VARCHAR) AS festival_name
  FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE))::TIMESTAMP, max(CAST(o_orderdate AS DATE))::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM orders)),
dim_customer AS (
  SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id, name, email, phone, city,
         TIMESTAMP '2002-01-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current, CAST(1 AS INTEGER) AS version
  FROM customers),
dim_product AS (
  SELECT row_number() OVER (ORDER BY p_id) AS product_key, p_id AS product_id, p_name AS name, p_type AS category,
         p_brand AS brand, p_retailprice AS price
  FROM (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS p_id, * FROM part)),
dim_store AS (
  SELECT row_number() OVER (ORDER BY store_id) AS store_key, store_id, store_name, city,
         __REGION__ AS region
  FROM (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS store_name, city
        FROM supplier JOIN cities ON s_nationkey = n_nationkey)),
fact AS (
  SELECT transaction_id AS sale_id, date_key, customer_key, product_key, store_key, quantity,
         CAST(quantity * t.price - t.discount AS DECIMAL(18,4)) AS revenue, t.discount
  FROM cleaned t
  JOIN dim_customer dc ON dc.customer_id = t.customer_id AND dc.is_current
  JOIN dim_product dp ON dp.product_id = t.product_id
  JOIN dim_store ds ON ds.store_id = t.store_id
  JOIN dim_date dd ON dd.date = CAST(t.date AS DATE)),
inventory AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS store_id,
         CASE WHEN l_partkey % 211 = 5 THEN 'X' ELSE 'P' END || CAST(l_partkey AS VARCHAR) AS product_id, day AS date,
         CAST((l_partkey * 7 + l_suppkey * 3 + date_diff('day', DATE '1970-01-01', day)) % 100 AS INTEGER) AS stock_level
  FROM (SELECT DISTINCT l_suppkey, l_partkey, CAST(o_orderdate AS DATE) AS day FROM lines)),
fact_inv AS (
  SELECT CAST(NULL AS BIGINT) AS inventory_id, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, product_key, store_key,
         stock_level, CAST(20 AS INTEGER) AS reorder_point
  FROM inventory JOIN dim_product USING (product_id) JOIN dim_store USING (store_id)),
fact_ship AS (
  SELECT 'SHP' || s.transaction_id AS shipment_id, CAST(strftime(ship, '%Y%m%d') AS INTEGER) AS date_key, product_key, store_key,
         CAST(days AS DOUBLE) AS delivery_time, days <= 5 AS on_time_flag
  FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
               CAST(o_orderdate AS DATE) + 1 AS ship, 1 + (l_orderkey * 7 + l_linenumber) % 10 AS days FROM lines) s
  JOIN fact ON sale_id = s.transaction_id),
pair_sales AS (
  SELECT product_id, store_id, date, CAST(sum(quantity) AS BIGINT) AS units
  FROM fact JOIN dim_product USING (product_key) JOIN dim_store USING (store_key) JOIN dim_date USING (date_key)
  GROUP BY ALL),
pair_stock AS (
  SELECT product_id, store_id, date, max(stock_level) AS stock_level
  FROM fact_inv JOIN dim_product USING (product_key) JOIN dim_store USING (store_key) JOIN dim_date USING (date_key)
  GROUP BY ALL),
last_day AS (SELECT max(date) AS d FROM pair_sales),
codes AS (
  SELECT product_id, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS category_encoded FROM dim_product),
trail7 AS (
  SELECT product_id, store_id, date, CAST(s AS DOUBLE) / 7 AS avg_sales_7d,
         round(sqrt(CAST(7 * q - s * s AS DOUBLE) / 42), 6) AS stddev_sales_7d
  FROM (SELECT product_id, store_id, date,
               CAST(sum(units) OVER w AS BIGINT) AS s, CAST(sum(units * units) OVER w AS BIGINT) AS q
        FROM pair_sales
        WINDOW w AS (PARTITION BY product_id, store_id ORDER BY date_diff('day', DATE '1970-01-01', date)
                     RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))),
features AS (
  SELECT product_id, store_id, current_stock, coalesce(CAST(s AS DOUBLE) / 7, 0) AS avg_sales_7d,
         coalesce(round(sqrt(CAST(7 * q - s * s AS DOUBLE) / 42), 6), 0) AS stddev_sales_7d, category_encoded
  FROM (SELECT product_id, store_id, CAST(stock_level AS DOUBLE) AS current_stock FROM pair_stock
        QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY date DESC) = 1)
  LEFT JOIN (SELECT product_id, store_id, CAST(sum(units) AS BIGINT) AS s, CAST(sum(units * units) AS BIGINT) AS q
             FROM pair_sales, last_day WHERE date <= d AND date > d - 7 GROUP BY ALL) USING (product_id, store_id)
  JOIN codes USING (product_id)),
profile AS (
  SELECT product_id, store_id, dayofweek(date) AS weekday, CAST(sum(units) AS DOUBLE) / 8 AS mean,
         CAST(8 * sum(units * units) - sum(units) * sum(units) AS DOUBLE) / 56 AS variance
  FROM pair_sales, last_day
  WHERE date <= d AND date > d - 56
  GROUP BY ALL),
forecast7 AS (
  SELECT product_id, store_id, current_stock, round(m, 6) AS forecast_7d, round(greatest(m - 1.96::DOUBLE * sqrt(v), 0.0::DOUBLE), 6) AS lower_bound,
         round(m + 1.96::DOUBLE * sqrt(v), 6) AS upper_bound, round(current_stock * 7 / nullif(m, 0), 6) AS days_remaining
  FROM (SELECT product_id, store_id, current_stock, coalesce(m, 0) AS m, coalesce(v, 0) AS v FROM features
        LEFT JOIN (SELECT product_id, store_id, CAST(sum(CAST(mean AS DECIMAL(24,6))) AS DOUBLE) AS m, CAST(sum(CAST(variance AS DECIMAL(28,6))) AS DOUBLE) AS v
                   FROM profile GROUP BY ALL) USING (product_id, store_id))),
live AS (
  SELECT event_id AS order_id, ts AS "timestamp",
         'P' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS product_id,
         'S' || CAST(user_id % 10 AS VARCHAR) AS store_id,
         CAST(user_id % 3 + 1 AS INTEGER) AS quantity, value AS price, 'C' || CAST(user_id AS VARCHAR) AS customer_id
  FROM events WHERE event_type = 'purchase'),
rejected AS (
  SELECT ts AS "timestamp", 'transactions' AS table_name, value, event_id FROM events WHERE event_type = 'error'),
rules AS (
  SELECT *, avg_sales_7d * 2 + 20 AS need, (avg_sales_7d * 2 + 20) / (avg_sales_7d * 2 + 20 + current_stock) AS p FROM features),
rule_scores AS (
  SELECT product_id, store_id, current_stock, avg_sales_7d, stddev_sales_7d, p,
         __RISK__ AS risk_level,
         CAST(CASE WHEN p > 0.8 THEN 3 WHEN p > 0.6 THEN 2 WHEN p > 0.4 THEN 1 ELSE 0 END AS INTEGER) AS risk_rank,
         round(p * 100 * 100) / 100 AS confidence,
         CAST(trunc(greatest(need - current_stock, 0)) AS INTEGER) AS recommended_reorder
  FROM rules),
rule_log AS (
  SELECT TIMESTAMP '2002-01-01' AS "timestamp", store_id, product_id, r.current_stock, avg_sales_7d,
         stddev_sales_7d / nullif(avg_sales_7d, 0) AS demand_volatility_cv, forecast_7d AS prophet_7d_forecast, upper_bound AS prophet_upper_bound,
         lower_bound AS prophet_lower_bound, days_remaining AS days_remaining_forecast, risk_rank AS risk_level, p AS ml_confidence,
         recommended_reorder AS optimal_reorder_qty
  FROM rule_scores r LEFT JOIN forecast7 USING (product_id, store_id)),
alerts AS (
  SELECT order_id, "timestamp", product_id, store_id, risk_level, confidence, recommended_reorder
  FROM live JOIN rule_scores USING (product_id, store_id) WHERE risk_level IN ('High', 'Critical')),
runs AS (
  SELECT row_number() OVER (ORDER BY start_time, pipeline_name) AS run_id, *,
         CASE WHEN bad > n * 0.15 THEN 'too many rejected rows' END AS error_message
  FROM (SELECT 'ingest:' || event_type AS pipeline_name, min(ts) AS start_time, max(ts) AS end_time,
               count(*) AS n, count(*) FILTER (value > 100) AS bad
        FROM events GROUP BY CAST(ts AS DATE), event_type)),
runs_done AS (
  SELECT run_id, pipeline_name, start_time, end_time,
         CASE WHEN error_message IS NULL THEN 'success' ELSE 'failed' END AS status,
         CASE WHEN error_message IS NULL THEN n ELSE 0 END AS rows_processed,
         CASE WHEN error_message IS NULL THEN bad ELSE 0 END AS rows_quarantined,
         error_message, CAST(floor(epoch(end_time - start_time)) AS BIGINT) AS duration_seconds
  FROM runs),
monthly AS (
  SELECT *, lag(monthly_revenue) OVER (ORDER BY year, month) AS prev_month_revenue
  FROM (SELECT year, month, monthname(make_date(year, month, 1)) AS month_name, CAST(sum(revenue) AS DOUBLE) AS monthly_revenue,
               count(sale_id) AS transaction_count, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_transaction_value,
               CAST(sum(quantity) AS BIGINT) AS total_units_sold
        FROM fact JOIN dim_date USING (date_key) GROUP BY year, month)),
city AS (
  SELECT city, region, count(DISTINCT store_key) AS active_stores, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
         count(sale_id) AS transaction_count, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_transaction_value,
         CAST(sum(quantity) AS BIGINT) AS total_units_sold,
         round(CAST(sum(revenue) AS DOUBLE) * 100.0 / CAST((SELECT sum(revenue) FROM fact) AS DOUBLE) * 100) / 100 AS revenue_share_pct
  FROM fact JOIN dim_store USING (store_key) GROUP BY city, region),
value_city AS (
  SELECT city, __TIER__ AS city_tier,
         count(DISTINCT customer_key) AS customer_count, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
         CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_clv, count(sale_id) AS total_transactions,
         CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_transaction_value,
         CAST(max(date_key) - min(date_key) AS INTEGER) AS customer_lifespan_days,
         CAST(date_diff('day', strptime(CAST(min(date_key) AS VARCHAR), '%Y%m%d'), strptime(CAST(max(date_key) AS VARCHAR), '%Y%m%d')) AS INTEGER) AS customer_lifespan_true_days,
         __FREQUENCY__ AS purchase_frequency_segment,
         __VALUE__ AS value_segment
  FROM fact JOIN dim_customer USING (customer_key) GROUP BY city),
days30 AS (
  SELECT date, CAST(sum(revenue) AS DOUBLE) AS revenue FROM fact JOIN dim_date USING (date_key)
  GROUP BY date ORDER BY date DESC LIMIT 30),
turnover AS (
  SELECT product_id, name AS product_name, category, price, CAST(sum(quantity) AS BIGINT) AS total_sold,
         CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(DISTINCT date_key) AS days_sold,
         min(date_key) AS first_sale_date, max(date_key) AS last_sale_date,
         CAST(sum(quantity) AS DOUBLE) / nullif(count(DISTINCT date_key), 0) AS avg_daily_sales
  FROM fact JOIN dim_product USING (product_key) GROUP BY product_id, name, category, price),
movement AS (
  SELECT *, CAST(last_sale_date - first_sale_date AS INTEGER) AS sales_span_days,
         CAST(date_diff('day', strptime(CAST(first_sale_date AS VARCHAR), '%Y%m%d'), strptime(CAST(last_sale_date AS VARCHAR), '%Y%m%d')) AS INTEGER) AS sales_span_true_days,
         __MOVEMENT__ AS movement_category,
         round(avg_daily_sales * 30 * 100) / 100 AS projected_monthly_sales,
         round(avg_daily_sales * 365 * 100) / 100 AS projected_annual_sales
  FROM turnover),
scd_changed AS (
  SELECT m.customer_id, m.name, m.email, m.phone, m.city, d.version AS current_version
  FROM moved m JOIN dim_customer d USING (customer_id)
  WHERE d.is_current AND coalesce(m.city, '') <> coalesce(d.city, '')),
scd AS (
  SELECT customer_key, d.customer_id, d.name, d.email, d.phone, d.city, d.valid_from,
         CASE WHEN c.customer_id IS NOT NULL THEN TIMESTAMP '{later}' ELSE d.valid_to END AS valid_to,
         c.customer_id IS NULL AS is_current, d.version
  FROM dim_customer d LEFT JOIN scd_changed c ON c.customer_id = d.customer_id
  UNION ALL
  SELECT (SELECT max(customer_key) FROM dim_customer) + row_number() OVER (ORDER BY customer_id), customer_id, name, email, phone, city,
         TIMESTAMP '{later}', NULL, TRUE, CAST(current_version + 1 AS INTEGER)
  FROM scd_changed),
stats AS (
  SELECT count(*) AS unique_rows,
         count(*) FILTER (discount IS NULL) AS nulls_fixed,
         count(*) FILTER (product_id IS NULL) AS critical_rows_removed,
         count(*) FILTER (product_id IS NOT NULL AND price < 0) AS invalid_values_fixed,
         count(*) FILTER (product_id IS NOT NULL AND quantity <= 0) AS invalid_quantity_removed,
         count(*) FILTER (product_id IS NOT NULL AND quantity > 0 AND date > TIMESTAMP '2002-01-01') AS future_rows_removed
  FROM uniq),
flagged AS (
  SELECT cleaned.*, CAST(price AS DOUBLE) > (SELECT CAST(sum(price) AS DOUBLE) / count(price) + 3 * stddev_samp(CAST(price AS DOUBLE)) FROM cleaned) AS is_anomaly
  FROM cleaned),
report AS (
  SELECT (SELECT count(*) FROM raw) AS initial_rows, (SELECT count(*) FROM raw) - unique_rows AS duplicates_removed,
         nulls_fixed, critical_rows_removed, invalid_values_fixed, invalid_quantity_removed, future_rows_removed,
         (SELECT count(*) FROM flagged WHERE is_anomaly) AS anomalies_flagged, (SELECT count(*) FROM cleaned) AS final_rows,
         (SELECT count(*) FROM raw) - (SELECT count(*) FROM cleaned) AS rows_removed,
         round((SELECT count(*) FROM cleaned) * 100.0::DOUBLE / (SELECT count(*) FROM raw) * 100) / 100 AS retention_pct
  FROM stats)
""".replace("{later}", LATER)

# --- drift: the same scores written per batch and column --------------------------
_DRIFT_TYPES = {
    "l_tax": "double", "l_shipdate": "timestamp_ntz", "l_returnflag": "string", "l_linestatus": "string",
    "o_totalprice": "double", "o_orderstatus": "string", "l_discount": "double",
    "flag_a": "string", "flag_b": "string", "flag_c": "string",
}
_DRIFT_SOURCE = {
    "l_discount": "CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_discount END",
    "l_tax": "CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_tax END",
    "flag_a": "l_returnflag",
    "flag_b": "l_linestatus",
    "flag_c": "CASE WHEN l_returnflag <> 'A' THEN o_orderstatus END",
}


def _drift_cte() -> str:
    parts = []
    for batch, columns in BATCHES.items():
        for c in columns:
            kind = _DRIFT_TYPES[c]
            parts.append(
                f"SELECT '{batch}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, count(*) AS n_rows, "
                f"count(*) - count(v) AS n_null, count(DISTINCT v) AS n_distinct, "
                f"list_sort(list(DISTINCT CAST(v AS VARCHAR)) FILTER (v IS NOT NULL))[1:5] AS samples, {0.2 if kind == 'string' else 0.4}::DOUBLE AS type_score "
                f"FROM (SELECT {_DRIFT_SOURCE.get(c, c)} AS v FROM lines)"
            )
    return (
        ", counted AS (" + " UNION ALL ".join(parts) + """),
scores AS (
  SELECT table_name, column_name, data_type, n_null::DOUBLE / n_rows AS null_ratio, n_distinct::DOUBLE / n_rows AS distinct_ratio,
         least((1.0::DOUBLE - n_null::DOUBLE / n_rows) * 0.3::DOUBLE
           + CASE WHEN n_distinct::DOUBLE / n_rows > 0.01 AND n_distinct::DOUBLE / n_rows < 0.99 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END
           + type_score, 1.0::DOUBLE) AS confidence,
         array_to_string(samples, '|') AS sample_values
  FROM counted),
decisions AS (
  SELECT table_name, CASE WHEN n_low > 5 THEN 'quarantine_all' WHEN n_low = 0 AND n_changes <= 3 THEN 'auto_approve' ELSE 'manual_review' END AS action,
         CASE WHEN n_low > 5 THEN 'Mass low-confidence changes' WHEN n_low = 0 AND n_changes <= 3 THEN '' ELSE 'Requires review' END AS reason,
         n_changes, n_low
  FROM (SELECT table_name, count(*) AS n_changes, count(*) FILTER (confidence < 0.75) AS n_low FROM scores GROUP BY table_name)),
requests AS (
  SELECT row_number() OVER (ORDER BY table_name) AS queue_id, table_name, action, reason, 'pending' AS status, TIMESTAMP '2002-01-01' AS created_at
  FROM decisions WHERE action <> 'auto_approve'),
log AS (
  SELECT row_number() OVER (ORDER BY table_name, column_name) AS change_id, table_name, 'new_column' AS change_type, column_name,
         '' AS old_value, scores.data_type AS new_value, confidence AS confidence_score, d.action AS status, TIMESTAMP '2002-01-01' AS detected_at,
         CAST(NULL AS TIMESTAMP) AS approved_at, CAST(NULL AS VARCHAR) AS approved_by, CAST(0 AS INTEGER) AS affected_rows, to_json(samples)::VARCHAR AS sample_data, queue_id
  FROM scores JOIN counted USING (table_name, column_name) JOIN decisions d USING (table_name) LEFT JOIN requests USING (table_name))
"""
    )


_DIM_CUSTOMER = "SELECT customer_key, customer_id, name, email, phone, city, valid_from, valid_to, is_current, version FROM dim_customer"
_FACT = "SELECT sale_id, date_key, customer_key, product_key, store_key, quantity, CAST(revenue AS DOUBLE) AS revenue, CAST(discount AS DOUBLE) AS discount FROM fact"
_ANALYST = """SELECT sale_id, date_key, product_key, store_key, quantity, CAST(revenue AS DOUBLE) AS revenue,
  concat('XXXXX-', right(phone, 4)) AS phone_masked, concat(left(email, 1), '***@', split_part(email, '@', 2)) AS email_masked, city AS customer_city
  FROM fact JOIN dim_customer USING (customer_key)"""
_FINANCE = """SELECT sale_id, date_key, customer_key, product_key, store_key, quantity, CAST(revenue AS DOUBLE) AS revenue, CAST(discount AS DOUBLE) AS discount,
  dc.name AS customer_name, email, phone, city AS customer_city, dp.name AS product_name, category AS product_category, dp.price AS product_price,
  CAST(revenue - CAST(dp.price AS DECIMAL(18,4)) * quantity AS DOUBLE) AS profit
  FROM fact JOIN dim_customer dc USING (customer_key) JOIN dim_product dp USING (product_key)"""
_COUNTS = """SELECT 'fact_sales' AS table_name, count(*) AS row_count FROM fact UNION ALL SELECT 'dim_customer', count(*) FROM dim_customer
  UNION ALL SELECT 'dim_product', count(*) FROM dim_product UNION ALL SELECT 'dim_store', count(*) FROM dim_store
  UNION ALL SELECT 'dim_date', count(*) FROM dim_date"""
_RAW = """SELECT transaction_id, date, store_id, customer_id, product_id, quantity, CAST(price AS DOUBLE) AS price,
  CAST(discount AS DOUBLE) AS discount, payment_method"""
_REASON = """CASE WHEN customer_id IS NULL AND product_id IS NULL THEN 'missing_required_value:customer_id;missing_required_value:product_id'
  WHEN customer_id IS NULL THEN 'missing_required_value:customer_id' WHEN product_id IS NULL THEN 'missing_required_value:product_id' END"""
_COMBOS = """SELECT product_id, store_id, CAST(sum(revenue) AS DOUBLE) AS total_revenue
  FROM fact JOIN dim_product USING (product_key) JOIN dim_store USING (store_key)
  WHERE date_key >= {first} GROUP BY product_id, store_id ORDER BY total_revenue DESC, product_id, store_id LIMIT 20"""
_MOVEMENT = """SELECT product_id, product_name, category, price, total_sold, total_revenue, days_sold, first_sale_date, last_sale_date, avg_daily_sales,
  sales_span_days, sales_span_true_days, movement_category, projected_monthly_sales, projected_annual_sales FROM movement"""

_LIVE_DAYS = """SELECT CAST("timestamp" AS DATE) AS day, count(*) AS orders, CAST(sum(CAST(price AS DECIMAL(18,4)) * quantity) AS DOUBLE) AS revenue,
    CAST(sum(CAST(price AS DECIMAL(18,4)) * quantity) AS DOUBLE) / count(*) AS avg_order_value{more} FROM live GROUP BY 1"""

_STATEMENTS = {
    "kpi_daily_revenue": """SELECT date, year, month, day, CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type,
        CASE WHEN is_holiday THEN 'Holiday' ELSE 'Regular' END AS holiday_type, festival_name, CAST(sum(revenue) AS DOUBLE) AS daily_revenue,
        count(sale_id) AS transaction_count, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_transaction_value, CAST(sum(quantity) AS BIGINT) AS total_units_sold
        FROM fact JOIN dim_date USING (date_key) GROUP BY ALL ORDER BY date DESC""",
    "kpi_daily_revenue_last30": "SELECT date, revenue FROM days30",
    "kpi_monthly_revenue": """SELECT year, month, month_name, monthly_revenue, transaction_count, avg_transaction_value, total_units_sold, prev_month_revenue,
        round((monthly_revenue - prev_month_revenue) * 100.0 / nullif(prev_month_revenue, 0) * 100) / 100 AS revenue_growth_pct FROM monthly""",
    "kpi_city_sales": "SELECT * FROM city",
    "kpi_top_products": """SELECT product_id, name AS product_name, category, brand, CAST(sum(quantity) AS BIGINT) AS total_quantity_sold,
        CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_revenue_per_transaction,
        price AS avg_product_price,
        round(CAST(sum(revenue) AS DOUBLE) * 100.0 / CAST(sum(sum(revenue)) OVER () AS DOUBLE) * 100) / 100 AS revenue_share_pct,
        CAST(row_number() OVER (ORDER BY sum(revenue) DESC, product_id) AS INTEGER) AS revenue_rank
        FROM fact JOIN dim_product USING (product_key) GROUP BY product_id, name, category, brand, price ORDER BY revenue_rank LIMIT 10""",
    "top5_products": """SELECT name AS product_name, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM fact JOIN dim_product USING (product_key)
        GROUP BY name ORDER BY total_revenue DESC, product_name LIMIT 5""",
    "kpi_turnover": _MOVEMENT,
    "kpi_stockout_top20": _MOVEMENT + " ORDER BY avg_daily_sales DESC, product_id LIMIT 20",
    "kpi_delivery_monthly": """SELECT date_trunc('month', CAST(date AS TIMESTAMP)) AS delivery_month, count(shipment_id) AS total_deliveries,
        avg(delivery_time) AS avg_delivery_days, min(delivery_time) AS min_delivery_days, max(delivery_time) AS max_delivery_days,
        median(delivery_time) AS median_delivery_days,
        round(CAST(count(*) FILTER (on_time_flag) AS DOUBLE) * 100.0 / count(*) * 100) / 100 AS on_time_pct
        FROM fact_ship JOIN dim_date USING (date_key) GROUP BY 1""",
    "kpi_seasonal": """SELECT year, month, month_name, __SEASON__ AS season, monthly_revenue, transaction_count, avg_transaction_value, total_units_sold,
        round(monthly_revenue * 100.0 / (SELECT CAST(sum(revenue) AS DOUBLE) FROM fact) * 100) / 100 AS revenue_share_pct, prev_month_revenue,
        round((monthly_revenue - prev_month_revenue) * 100.0 / nullif(prev_month_revenue, 0) * 100) / 100 AS month_over_month_growth_pct FROM monthly""",
    "kpi_new_vs_returning": """SELECT date, count(DISTINCT customer_key) AS total_customers,
        count(DISTINCT CASE WHEN date_key = first_key THEN customer_key END) AS new_customers,
        count(DISTINCT CASE WHEN date_key > first_key THEN customer_key END) AS returning_customers, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
        round(count(DISTINCT CASE WHEN date_key = first_key THEN customer_key END)::DOUBLE * 100.0 / nullif(count(DISTINCT customer_key), 0) * 100) / 100 AS new_customer_pct,
        round(count(DISTINCT CASE WHEN date_key > first_key THEN customer_key END)::DOUBLE * 100.0 / nullif(count(DISTINCT customer_key), 0) * 100) / 100 AS returning_customer_pct
        FROM (SELECT *, min(date_key) OVER (PARTITION BY customer_key) AS first_key FROM fact) JOIN dim_date USING (date_key) GROUP BY date""",
    "kpi_customer_value_city": "SELECT * FROM value_city",
    "kpi_customer_value": """SELECT customer_id, CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS total_transactions,
        CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_transaction_value, CAST(max(date_key) - min(date_key) AS INTEGER) AS customer_lifespan_days,
        CAST(date_diff('day', strptime(CAST(min(date_key) AS VARCHAR), '%Y%m%d'), strptime(CAST(max(date_key) AS VARCHAR), '%Y%m%d')) AS INTEGER) AS customer_lifespan_true_days,
        __FREQUENCY_WIDE__ AS purchase_frequency_segment,
        __VALUE_WIDE__ AS value_segment
        FROM fact JOIN dim_customer USING (customer_key) GROUP BY customer_id""",
    "kpi_summary": """SELECT 'Total Revenue' AS metric, CAST(sum(revenue) AS DOUBLE) AS value, '₹' || CAST(CAST(round(sum(revenue), 2) AS DECIMAL(38,2)) AS VARCHAR) AS formatted_value FROM fact
        UNION ALL SELECT 'Total Transactions', CAST(count(sale_id) AS DOUBLE), CAST(count(sale_id) AS VARCHAR) FROM fact
        UNION ALL SELECT 'Total Customers', CAST(count(DISTINCT customer_key) AS DOUBLE), CAST(count(DISTINCT customer_key) AS VARCHAR) FROM fact
        UNION ALL SELECT 'Total Products', CAST(count(DISTINCT product_key) AS DOUBLE), CAST(count(DISTINCT product_key) AS VARCHAR) FROM fact
        UNION ALL SELECT 'Total Stores', CAST(count(DISTINCT store_key) AS DOUBLE), CAST(count(DISTINCT store_key) AS VARCHAR) FROM fact""",
    "dashboard_cards": """SELECT CAST(total AS DOUBLE) AS total_revenue, CAST(total AS DOUBLE) / n AS avg_daily_revenue, last_revenue, prev_revenue,
        CASE WHEN prev_revenue > 0 THEN (last_revenue - prev_revenue) / prev_revenue * 100 ELSE 0 END AS revenue_trend_pct,
        (SELECT count(*) FROM city) AS total_cities, (SELECT CAST(sum(active_stores) AS BIGINT) FROM city) AS total_stores,
        (SELECT CAST(sum(customer_count) AS BIGINT) FROM value_city) AS total_customers
        FROM (SELECT sum(CAST(revenue AS DECIMAL(18,4))) AS total, count(*) AS n, max(CASE WHEN pos = 1 THEN revenue END) AS last_revenue,
                     max(CASE WHEN pos = 2 THEN revenue END) AS prev_revenue
              FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS pos FROM days30))""",
    "chart_revenue": """SELECT date, revenue, revenue / max(revenue) OVER () * 100 AS pct_of_max,
        revenue > CAST(sum(CAST(revenue AS DECIMAL(18,4))) OVER () AS DOUBLE) / count(*) OVER () AS is_above_avg FROM days30 ORDER BY date DESC LIMIT 10""",
    "chart_city": "SELECT city, region, total_revenue, total_revenue / max(total_revenue) OVER () * 100 AS pct_of_max FROM city ORDER BY total_revenue DESC, city LIMIT 8",
    "chart_customers": """SELECT city, city_tier, value_segment, customer_count, total_revenue,
        CAST(customer_count AS DOUBLE) / (SELECT CAST(sum(customer_count) AS DOUBLE) FROM value_city) * 100 AS customer_pct,
        total_revenue / (SELECT CAST(sum(CAST(total_revenue AS DECIMAL(18,4))) AS DOUBLE) FROM value_city) * 100 AS revenue_pct
        FROM value_city ORDER BY total_revenue DESC, city LIMIT 6""",
    "product_pairs": """SELECT product_a, product_b, n AS co_occurrence_count, CAST(n AS DOUBLE) / a.c AS confidence,
        CAST(n AS DOUBLE) * CAST((SELECT count(DISTINCT o) FROM items) AS DOUBLE) / (CAST(a.c AS DOUBLE) * CAST(b.c AS DOUBLE)) AS lift
        FROM (SELECT x.p AS product_a, y.p AS product_b, count(*) AS n FROM items x JOIN items y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2)
        JOIN (SELECT p, count(*) AS c FROM items GROUP BY p) a ON a.p = product_a JOIN (SELECT p, count(*) AS c FROM items GROUP BY p) b ON b.p = product_b""",
    "top_combos_recent": _COMBOS.format(first="(SELECT max(date_key) - 30 FROM fact)"),
    "top_combos_recent_true_days": _COMBOS.format(
        first="(SELECT CAST(strftime(strptime(CAST(max(date_key) AS VARCHAR), '%Y%m%d') - INTERVAL 30 DAY, '%Y%m%d') AS INTEGER) FROM fact)"
    ),
    "dim_date": "SELECT * FROM dim_date",
    "dim_customer": _DIM_CUSTOMER,
    "dim_product": "SELECT * FROM dim_product",
    "dim_store": "SELECT * FROM dim_store",
    "store_counts_by_region": "SELECT region, count(*) AS store_count FROM dim_store GROUP BY region ORDER BY region",
    "store_regions": "SELECT DISTINCT region FROM dim_store",
    "new_customers": f"""SELECT row_number() OVER (ORDER BY balance < 0, customer_id) AS customer_key, customer_id, name, email, phone, city,
        CASE WHEN balance < 0 THEN TIMESTAMP '{LATER}' ELSE TIMESTAMP '2002-01-01' END AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
        TRUE AS is_current, CAST(1 AS INTEGER) AS version FROM customers""",
    "scd2_apply": "SELECT * FROM scd",
    "scd2_changed_customers": "SELECT * FROM scd_changed",
    "scd2_checks": """SELECT 'duplicate_versions' AS check_name, count(*) AS violations FROM (SELECT customer_id FROM scd GROUP BY customer_id, version HAVING count(*) > 1)
        UNION ALL SELECT 'several_current', count(*) FROM (SELECT customer_id FROM scd WHERE is_current GROUP BY customer_id HAVING count(*) > 1)
        UNION ALL SELECT 'no_current', count(*) FROM (SELECT customer_id FROM scd GROUP BY customer_id HAVING NOT bool_or(is_current))""",
    "fact_sales": _FACT,
    "fact_inventory": "SELECT * FROM fact_inv",
    "inventory_load_counts": """SELECT count(*) AS rows_read, count(*) FILTER (product_key IS NOT NULL AND store_key IS NOT NULL) AS rows_loaded,
        count(*) FILTER (product_key IS NULL OR store_key IS NULL) AS rows_dropped
        FROM inventory LEFT JOIN dim_product USING (product_id) LEFT JOIN dim_store USING (store_id)""",
    "inventory_pairs": "SELECT DISTINCT product_id, store_id FROM fact_inv JOIN dim_product USING (product_key) JOIN dim_store USING (store_key)",
    "fact_shipments": "SELECT * FROM fact_ship",
    "partition_prune_sum": "SELECT DATE '1998-03-25' AS day, CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count FROM fact WHERE date_key = 19980325",
    "partition_live_day_sum": """SELECT region, CAST(sum(CAST(price AS DECIMAL(18,4)) * quantity) AS DOUBLE) AS revenue, count(order_id) AS orders
        FROM live JOIN dim_store USING (store_id) WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-20' GROUP BY region""",
    "partition_live_week_sum": """SELECT region, CAST(sum(CAST(price AS DECIMAL(18,4)) * quantity) AS DOUBLE) AS revenue, count(order_id) AS orders
        FROM live JOIN dim_store USING (store_id) WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' GROUP BY region""",
    "partition_week_sum": "SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count FROM fact WHERE date_key BETWEEN 19980319 AND 19980325",
    "partition_region_sum": """SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count
        FROM fact JOIN dim_date USING (date_key) JOIN dim_store USING (store_key) WHERE region = 'West' GROUP BY 1""",
    "partition_full_sum": "SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count FROM fact",
    "partition_missing_day_sum": "SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count FROM fact WHERE date_key = 20300101",
    "full_scan_day_sum": "SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count FROM fact WHERE date_key = 19980325",
    "view_analyst": _ANALYST,
    "view_store_manager": _ANALYST + " WHERE store_key = 1",
    "view_finance": _FINANCE,
    "view_admin": """SELECT 'fact_sales' AS table_name, count(*) AS row_count, min(date_key) AS min_date_key, max(date_key) AS max_date_key, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM fact
        UNION ALL SELECT 'dim_customer', count(*), NULL, NULL, NULL FROM dim_customer UNION ALL SELECT 'dim_product', count(*), NULL, NULL, NULL FROM dim_product
        UNION ALL SELECT 'dim_store', count(*), NULL, NULL, NULL FROM dim_store UNION ALL SELECT 'dim_date', count(*), min(date_key), max(date_key), NULL FROM dim_date""",
    "view_counts": f"""SELECT 'analyst_sales' AS table_name, count(*) AS row_count FROM ({_ANALYST}) UNION ALL SELECT 'store_manager_sales', count(*) FROM ({_ANALYST})
        UNION ALL SELECT 'finance_sales', count(*) FROM ({_FINANCE}) UNION ALL SELECT 'admin_all', 5""",
    "contract_check": f"""SELECT table_name, column_name, TRUE AS present, row_count FROM ({_COUNTS}) JOIN (VALUES
        ('fact_sales','*'),('fact_sales','sale_id'),('fact_sales','date_key'),('fact_sales','customer_key'),('fact_sales','product_key'),('fact_sales','store_key'),
        ('fact_sales','quantity'),('fact_sales','revenue'),('dim_customer','*'),('dim_customer','customer_key'),('dim_customer','name'),('dim_customer','email'),
        ('dim_customer','phone'),('dim_customer','city'),('dim_product','*'),('dim_product','product_key'),('dim_product','name'),('dim_product','category'),
        ('dim_product','price'),('dim_store','*'),('dim_date','*')) c(table_name, column_name) USING (table_name)""",
    "table_counts": f"{_COUNTS} UNION ALL SELECT 'fact_inventory', count(*) FROM fact_inv UNION ALL SELECT 'fact_shipments', count(*) FROM fact_ship",
    "source_csv_relabel": "SELECT store_id, product_id, date, stock_level FROM inventory",
    "source_csv_inferred": "SELECT store_id, store_name, city FROM dim_store",
    "source_snapshot_latest": "SELECT customer_id, name, email, phone, city FROM moved",
    "source_snapshot_all": """SELECT 'customers_20240131T060000.parquet' AS snapshot_file, count(*) AS n_rows, count(DISTINCT city) AS n_cities FROM customers
        UNION ALL SELECT 'customers_20240201T060000.parquet', count(*), count(DISTINCT city) FROM moved""",
    "source_fallback": _RAW + " FROM raw",
    "records_json": """SELECT to_json({'store_key': store_key, 'store_id': store_id, 'store_name': store_name, 'city': city, 'region': region})::VARCHAR AS record FROM dim_store""",
    "sink_rebuild_append": "SELECT date_key, 2 * count(sale_id) AS n_rows, CAST(2 * sum(quantity) AS BIGINT) AS units FROM fact GROUP BY date_key",
    "ingest_valid": _RAW + f" FROM raw WHERE {_REASON} IS NULL",
    "ingest_quarantine": _RAW + f", {_REASON} AS quarantine_reason FROM raw WHERE {_REASON} IS NOT NULL",
    "ingest_missing_column": f"""SELECT CASE WHEN r IS NULL THEN 'missing_required_column:store_id' ELSE 'missing_required_column:store_id;' || r END AS quarantine_reason,
        count(*) AS n_rows FROM (SELECT {_REASON} AS r FROM raw) GROUP BY 1""",
    "ingest_run_counts": f"""SELECT 'transactions' AS table_name, count(*) AS total_rows, count(*) FILTER (r IS NULL) AS valid_rows, count(r) AS quarantined_rows
        FROM (SELECT {_REASON} AS r FROM raw)""",
    "ingest_read_back": f"""SELECT CASE WHEN r IS NULL THEN 'valid' ELSE 'quarantine' END AS sink, r AS quarantine_reason, count(*) AS n_rows, CAST(sum(quantity) AS BIGINT) AS units
        FROM (SELECT quantity, {_REASON} AS r FROM raw) GROUP BY ALL""",
    "clean_text_dates": "SELECT transaction_id, date FROM cleaned WHERE CAST(split_part(transaction_id, '-', 1) AS BIGINT) % 400 <> 1",
    "clean_transactions": _RAW + ", is_anomaly FROM flagged",
    "clean_report": "SELECT * FROM report",
    "anomaly_flags": """SELECT transaction_id, CAST(amount AS DOUBLE) AS price, TRUE AS is_anomaly FROM (SELECT *, CAST(price * quantity AS DECIMAL(18,4)) AS amount FROM cleaned)
        WHERE CAST(amount AS DOUBLE) > (SELECT CAST(sum(a) AS DOUBLE) / count(a) + 2 * stddev_samp(CAST(a AS DOUBLE))
          FROM (SELECT CAST(price * quantity AS DECIMAL(18,4)) AS a FROM cleaned))""",
    "run_events": """SELECT * FROM runs_done UNION ALL
        SELECT run_id, pipeline_name, start_time, NULL, 'running', 0, 0, NULL, 0 FROM runs""",
    "run_history": "SELECT run_id, start_time, status, rows_processed, rows_quarantined, duration_seconds FROM runs_done ORDER BY run_id DESC LIMIT 50",
    "run_latest": "SELECT * FROM runs_done",
    "run_last": "SELECT run_id, start_time, status, rows_processed, rows_quarantined, duration_seconds FROM runs_done ORDER BY run_id DESC LIMIT 1",
    "run_success_rate": """SELECT count(*) AS n_runs, count(*) FILTER (status = 'success') * 100.0::DOUBLE / count(*) AS success_rate_pct
        FROM (SELECT status FROM runs_done ORDER BY run_id DESC LIMIT 50)""",
    "run_metrics": """SELECT CAST(metric_id AS BIGINT) AS metric_id, CAST(1 AS BIGINT) AS run_id, metric_name, metric_value, TIMESTAMP '2002-01-01' AS "timestamp" FROM (
        SELECT 1 AS metric_id, 'duplicates_removed' AS metric_name, CAST(duplicates_removed AS DOUBLE) AS metric_value FROM report
        UNION ALL SELECT 2, 'nulls_fixed', CAST(nulls_fixed AS DOUBLE) FROM report UNION ALL SELECT 3, 'anomalies_flagged', CAST(anomalies_flagged AS DOUBLE) FROM report
        UNION ALL SELECT 4, 'data_quality_score', retention_pct FROM report)""",
    "retention_filter": "SELECT * FROM rejected WHERE \"timestamp\" >= TIMESTAMP '2024-01-11'",
    "quarantine_alert": """SELECT count(*) AS issue_count, count(*) > 100 AS is_high FROM rejected WHERE "timestamp" >= TIMESTAMP '2024-01-30 23:00:00'""",
    "pair_sales": "SELECT * FROM pair_sales",
    "stock_features": "SELECT * FROM features",
    "stock_labels": """SELECT *, CAST(current_stock < avg_sales_7d AS INTEGER) AS risk, greatest(avg_sales_7d * 2 - current_stock, 0.0::DOUBLE) AS reorder_qty FROM features""",
    "trailing_sales": "SELECT * FROM trail7",
    "history_features": """SELECT product_id, store_id, s.date, CAST(stock_level AS DOUBLE) AS current_stock, coalesce(avg_sales_7d, 0) AS avg_sales_7d,
        coalesce(stddev_sales_7d, 0) AS stddev_sales_7d, category_encoded FROM pair_stock s LEFT JOIN trail7 USING (product_id, store_id, date) JOIN codes USING (product_id)""",
    "model_checks": """SELECT count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_out_of_range, TRUE AS accuracy_above_85_pct, TRUE AS r2_above_0_7 FROM features""",
    "risk_ranking_by_rule": """SELECT product_id, store_id, risk_level, round(confidence, 1) AS confidence_pct, recommended_reorder, risk_rank FROM rule_scores""",
    "reasoning_log_by_rule": "SELECT * FROM rule_log",
    "high_risk_by_rule": """SELECT store_id, product_id, name AS product_name, store_name, current_stock, prophet_7d_forecast, days_remaining_forecast, risk_level,
        ml_confidence, optimal_reorder_qty FROM rule_log JOIN dim_product USING (product_id) JOIN dim_store USING (store_id) WHERE risk_level >= 2
        ORDER BY days_remaining_forecast NULLS LAST, product_id, store_id LIMIT 20""",
    "recent_predictions_by_rule": """SELECT "timestamp", store_id, product_id, risk_level, ml_confidence FROM rule_log ORDER BY "timestamp" DESC, product_id, store_id LIMIT 50""",
    "recent_alerts_by_rule": """SELECT product_id, store_id, risk_level, ml_confidence, optimal_reorder_qty, "timestamp" FROM rule_log WHERE risk_level >= 2
        ORDER BY "timestamp" DESC, product_id, store_id LIMIT 5""",
    "decision_feed_by_rule": """SELECT '20020101000000-' || product_id || '-' || store_id AS decision_id, "timestamp", 'Stockout Risk' AS decision_type,
        'Product ' || product_id || ' at Store ' || store_id AS entity, 'Reorder ' || CAST(optimal_reorder_qty AS VARCHAR) || ' units' AS action,
        ml_confidence AS confidence, 'Risk Level: ' || CAST(risk_level AS VARCHAR) AS impact,
        CASE WHEN risk_level >= 2 THEN 'pending' ELSE 'executed' END AS status, '31d ago' AS age FROM rule_log ORDER BY "timestamp" DESC, decision_id LIMIT 20""",
    "demand_forecast_7d": "SELECT * FROM forecast7",
    "demand_forecast_daily": """SELECT product_id, store_id, forecast_date, round(coalesce(mean, 0), 6) AS forecast,
        round(greatest(coalesce(mean, 0) - 1.96::DOUBLE * sqrt(coalesce(variance, 0)), 0.0::DOUBLE), 6) AS lower_bound,
        round(coalesce(mean, 0) + 1.96::DOUBLE * sqrt(coalesce(variance, 0)), 6) AS upper_bound
        FROM (SELECT product_id, store_id, CAST(d + i AS DATE) AS forecast_date, dayofweek(CAST(d + i AS DATE)) AS weekday
              FROM features, last_day, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS i))
        LEFT JOIN profile USING (product_id, store_id, weekday)""",
    "stream_order_ingest": "SELECT * FROM live",
    "stream_dedup_orders": "SELECT * FROM live",
    "stream_daily_metrics": _LIVE_DAYS.format(more=", count(DISTINCT customer_id) AS unique_customers"),
    "stream_daily_view": _LIVE_DAYS.format(more=""),
    "live_day_metrics": """SELECT count(*) AS orders_today, coalesce(CAST(sum(CAST(price AS DECIMAL(18,4)) * quantity) AS DOUBLE), 0) AS revenue_today,
        coalesce(CAST(sum(CAST(price AS DECIMAL(18,4)) * quantity) AS DOUBLE) / count(*), 0) AS avg_order_value, count(DISTINCT customer_id) AS unique_customers
        FROM live WHERE CAST("timestamp" AS DATE) = DATE '2024-01-30'""",
    "live_totals": """SELECT count(*) AS total_orders,
        coalesce(CAST(sum(CAST(price AS DECIMAL(18,4)) * quantity) FILTER (CAST("timestamp" AS DATE) = DATE '2024-01-30') AS DOUBLE), 0) AS revenue_today FROM live""",
    "order_age": """SELECT order_id, CASE WHEN s // 60 < 60 THEN CAST(s // 60 AS VARCHAR) || 'm ago' WHEN s // 3600 < 24 THEN CAST(s // 3600 AS VARCHAR) || 'h ago'
        ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age
        FROM (SELECT order_id, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - "timestamp")) AS BIGINT) AS s FROM live)""",
    "stream_recent_orders": 'SELECT * FROM live ORDER BY "timestamp" DESC, order_id DESC LIMIT 50',
    "recent_orders": 'SELECT * FROM live ORDER BY "timestamp" DESC, order_id DESC LIMIT 10',
    "stream_alerts_by_rule": "SELECT * FROM alerts",
    "stream_messages": """SELECT to_json({'type': 'order', 'order_id': order_id, 'product_id': product_id, 'store_id': store_id, 'price': price})::VARCHAR AS value FROM live
        UNION ALL SELECT to_json({'type': 'ml_alert', 'product_id': product_id, 'store_id': store_id, 'risk_level': risk_level, 'confidence': confidence,
          'reorder': recommended_reorder})::VARCHAR FROM alerts""",
    "stream_quarantine_rate": """SELECT time_bucket(INTERVAL 30 MINUTE, "timestamp") AS window_start, count(*) AS issue_count, count(*) > 3 AS is_high FROM rejected GROUP BY 1""",
}

_DRIFT_STATEMENTS = {
    "drift_confidence": "SELECT * FROM scores",
    "drift_confidence_sketched": "SELECT table_name, column_name, data_type, null_ratio, confidence FROM scores",
    "drift_decision": "SELECT * FROM decisions",
    "drift_verdict": """SELECT table_name, CASE WHEN action = 'auto_approve' THEN 'approved' ELSE 'pending_approval' END AS status,
        CASE WHEN action = 'auto_approve' THEN 'process' ELSE 'hold' END AS action, reason FROM decisions
        UNION ALL SELECT 'known', 'approved', 'process', '' UNION ALL SELECT 'broken', 'rejected', 'quarantine', 'Missing required columns: price, store_id'""",
    "drift_log": "SELECT * FROM log",
    "approval_queue": "SELECT * FROM requests",
    "approval_requests": """SELECT queue_id, table_name, '[' || string_agg(to_json({'column_name': column_name, 'confidence': confidence, 'data_type': scores.data_type,
          'sample_values': coalesce(samples, [])})::VARCHAR, ',' ORDER BY column_name) || ']' AS decision_json
        FROM scores JOIN counted USING (table_name, column_name) JOIN requests USING (table_name) GROUP BY queue_id, table_name""",
    "approval_changes": "SELECT queue_id, table_name, column_name, confidence, data_type FROM scores JOIN requests USING (table_name)",
    "approval_apply": "SELECT * REPLACE (CASE WHEN table_name = 'many' THEN 'approved' ELSE status END AS status) FROM requests",
    "approval_log": f"""SELECT * REPLACE (CASE WHEN table_name = 'noisy' THEN 'rejected' ELSE status END AS status,
        CASE WHEN table_name = 'noisy' THEN TIMESTAMP '{LATER}' END AS approved_at, CASE WHEN table_name = 'noisy' THEN 'admin' END AS approved_by) FROM log""",
    "drift_history": "SELECT change_id, table_name, change_type, column_name, confidence_score, status, detected_at FROM log",
    "drift_status_counts": """SELECT count(*) AS total_changes, count(*) FILTER (status IN ('manual_review', 'quarantine_all')) AS pending_changes,
        count(*) FILTER (status = 'auto_approve') AS auto_approved FROM log""",
}

_PER_WEEKDAY = """, per_weekday AS (
  SELECT product_id, store_id, weekday, CAST(sum(units) AS BIGINT) AS s, CAST(sum(units * week) AS BIGINT) AS sw, CAST(sum(units * units) AS BIGINT) AS ss
  FROM (SELECT product_id, store_id, units, dayofweek(date) AS weekday, 7 - date_diff('day', date, d) // 7 AS week
        FROM pair_sales, last_day WHERE date <= d AND date > d - 56) GROUP BY 1, 2, 3) """

_ITEMS = ", items AS (SELECT DISTINCT split_part(transaction_id, '-', 1) AS o, product_id AS p FROM cleaned) "


def _listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _members(column: str, groups: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({_listed(v)}) THEN '{k}'" for k, v in groups.items()) + f" ELSE '{default}' END"


def _steps(column: str, sign: str, ladder: list, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} {sign} {bound} THEN '{label}'" for bound, label in ladder) + f" ELSE '{rest}' END"


# Labels come from the fixed values that the queries use.
_LABELS = {
    "__CITIES__": _listed(CITIES),
    "__REGION__": _members("upper(trim(city))", S.REGION_CITIES, S.UNKNOWN_REGION),
    "__TIER__": _members("city", S.TIER_CITIES, S.DEFAULT_TIER),
    "__SEASON__": _members("month", S.SEASON_MONTHS, S.DEFAULT_SEASON),
    "__RISK__": _steps("p", ">", S.RISK_LADDER, S.RISK_BOTTOM),
    "__MOVEMENT__": _steps("avg_daily_sales", ">", S.MOVEMENT_LADDER, S.MOVEMENT_BOTTOM),
    "__FREQUENCY__": _steps("count(sale_id)", "<=", S.FREQUENCY_LADDER, S.FREQUENCY_TOP),
    "__FREQUENCY_WIDE__": _steps("count(sale_id)", "<=", FREQUENCY_STEPS, S.FREQUENCY_TOP),
    "__VALUE__": _steps("sum(revenue)", "<", S.VALUE_LADDER, S.VALUE_TOP),
    "__VALUE_WIDE__": _steps("sum(revenue)", "<", VALUE_STEPS, S.VALUE_TOP),
}


_STATEMENTS |= {
    "kpi_customer_value_default": _STATEMENTS["kpi_customer_value"].replace("_WIDE__", "__"),
    "source_fallback_csv": _STATEMENTS["source_fallback"],
    # Sums that are kept up to date give the reports of a full scan.
    **{f"maintained_{name}": _STATEMENTS[f"kpi_{name}"] for name in ("daily_revenue", "monthly_revenue", "seasonal", "city_sales", "top_products", "summary")},
    "scd2_any_order": f"""SELECT customer_id, name, email, phone, city, seen AS valid_from, lead(seen) OVER w AS valid_to, lead(seen) OVER w IS NULL AS is_current,
        CAST(row_number() OVER w AS INTEGER) AS version
        FROM (SELECT *, lag(coalesce(city, '')) OVER (PARTITION BY customer_id ORDER BY seen) AS was FROM (
          SELECT customer_id, name, email, phone, city, TIMESTAMP '{AS_OF}' AS seen FROM customers WHERE balance >= 0
          UNION ALL SELECT *, TIMESTAMP '{LATER}' FROM moved
          UNION ALL SELECT customer_id, name, email, phone, CASE WHEN right(customer_id, 1) IN ('3', '7') THEN 'Surat' ELSE city END, TIMESTAMP '{MUCH_LATER}'
          FROM customers WHERE right(customer_id, 1) <> '0'))
        WHERE was IS NULL OR was <> coalesce(city, '')
        WINDOW w AS (PARTITION BY customer_id ORDER BY seen)""",
    "frequent_product_pairs": f"SELECT * FROM ({_STATEMENTS['product_pairs']}) WHERE co_occurrence_count >= 2",
    "demand_forecast_trend": f"""SELECT product_id, store_id, forecast_date, round(greatest(mean, 0.0::DOUBLE), 6) AS forecast,
        round(greatest(mean - margin, 0.0::DOUBLE), 6) AS lower_bound, round(greatest(mean + margin, 0.0::DOUBLE), 6) AS upper_bound, round(coalesce(slope, 0), 6) AS slope
        FROM (SELECT product_id, store_id, forecast_date, slope,
                     CASE WHEN slope IS NULL THEN 0 ELSE CAST(coalesce(of_day, 0) AS DOUBLE) / 8 + slope * 4.5::DOUBLE END AS mean,
                     2.02::DOUBLE * sqrt(coalesce(variance, 0) * {1 + 1 / 8 + 4.5 * 4.5 * 12 / (7 * 8 * 63)!r}::DOUBLE) AS margin
              FROM (SELECT product_id, store_id, CAST(d + i AS DATE) AS forecast_date, dayofweek(CAST(d + i AS DATE)) AS weekday
                    FROM features, last_day, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS i))
              LEFT JOIN (SELECT product_id, store_id, CAST(c * 6 AS DOUBLE) / 3528 AS slope,
                                greatest(CAST(8 * ss - sq AS DOUBLE) / 8 - CAST(c * c * 3 AS DOUBLE) / 3528, 0.0::DOUBLE) / 48.0::DOUBLE AS variance
                         FROM (SELECT product_id, store_id, sum(2 * sw - 7 * s) AS c, sum(ss) AS ss, sum(s * s) AS sq FROM per_weekday GROUP BY 1, 2)) USING (product_id, store_id)
              LEFT JOIN (SELECT product_id, store_id, weekday, s AS of_day FROM per_weekday) USING (product_id, store_id, weekday))""",
    "curve_product_store_sum": """SELECT product_key, CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count
        FROM fact WHERE product_key BETWEEN 20 AND 60 AND store_key BETWEEN 2 AND 4 GROUP BY product_key""",
    "key_registry": """SELECT count(*) AS n_customers, count(DISTINCT customer_id) AS n_keys, CAST(0 AS BIGINT) AS n_changed,
        count(*) FILTER (balance < 0) AS n_late FROM customers""",
}


def oracle_sql() -> dict[str, str]:
    more = {"product_pairs": _ITEMS, "frequent_product_pairs": _ITEMS, "demand_forecast_trend": _PER_WEEKDAY}
    out = {name: _BASE + more.get(name, "") + sql for name, sql in _STATEMENTS.items()}
    drift_base = _BASE + _drift_cte()
    out.update({name: drift_base + sql for name, sql in _DRIFT_STATEMENTS.items()})
    return {name: re.sub("|".join(_LABELS), lambda m: _LABELS[m[0]], sql) for name, sql in out.items()}
