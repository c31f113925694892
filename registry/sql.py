"""Named sub-queries that the check SQL builds on, and the WITH clause that pulls in those a statement uses."""

from __future__ import annotations

import re

AS_OF = "DATE '1998-09-02'"

VIEWS: dict[str, str] = {}

VIEWS["v_lines"] = """
SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""
VIEWS["v_all_sales"] = """
SELECT l_orderkey AS order_id, o_orderdate::DATE AS order_date, l_shipdate::DATE AS shipment_date,
  l_partkey AS product_id, o_custkey AS customer_id, c_mktsegment AS customer_segment,
  l_extendedprice::DECIMAL(18,2) AS sales, l_quantity::INT AS quantity,
  (l_extendedprice::DECIMAL(18,2) * (0.06::DECIMAL(4,2) - l_discount::DECIMAL(4,2)))::DECIMAL(18,4) AS profit,
  (l_returnflag = 'R')::INT AS is_late_delivery, o_orderpriority AS shipping_mode, r_name AS market,
  IF(p_type = 'PROMO', 'Health and Beauty', p_type) AS department, p_brand AS class
FROM v_lines
"""
VIEWS["v_sales"] = """
SELECT * FROM v_all_sales
QUALIFY row_number() OVER (PARTITION BY order_id, product_id, order_date ORDER BY shipment_date DESC,
  customer_id DESC, customer_segment DESC, sales DESC, quantity DESC, profit DESC, is_late_delivery DESC,
  shipping_mode DESC, market DESC, department DESC, class DESC) = 1
"""
VIEWS["v_stock"] = """
SELECT p_partkey AS product_id, p_size AS lead_time, ((p_partkey * 37) % 400)::INT AS current_stock,
  p_size * 4 AS reorder_point, (p_partkey % 7)::INT AS avg_order, p_size * 2 AS safety_stock
FROM part WHERE p_brand <> 'Brand#9'
"""
VIEWS["v_all_supply"] = """
SELECT l_partkey AS sku, coalesce(MAP {'STANDARD': 'haircare', 'ECONOMY': 'skincare', 'PROMO': 'cosmetics'}[p_type], 'other')
    AS product_type,
  l_extendedprice::DECIMAL(18,2) AS revenue, l_quantity::INT AS stock_levels, p_size AS lead_times,
  l_linenumber::INT AS shipping_times, (l_tax::DECIMAL(4,2) * 100)::DECIMAL(10,2) AS shipping_costs,
  s_name AS supplier_name, (l_discount::DECIMAL(4,2) * 50)::DECIMAL(10,2) AS defect_rates
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""
VIEWS["v_supply"] = """
SELECT * FROM v_all_supply
QUALIFY row_number() OVER (PARTITION BY sku ORDER BY revenue DESC, product_type DESC, stock_levels DESC,
  lead_times DESC, shipping_times DESC, shipping_costs DESC, supplier_name DESC, defect_rates DESC) = 1
"""
VIEWS["v_types"] = """
SELECT product_type, sum(defect_rates)::DOUBLE / count(*) AS avg_defect_rate, max(defect_rates)::DOUBLE AS max_defect_rate,
  sum(shipping_costs)::DOUBLE / count(*) AS avg_shipping_cost, sum(shipping_times)::DOUBLE / count(*) AS avg_shipping_time,
  sum(lead_times)::DOUBLE / count(*) AS sc_avg_lead_time, sum(stock_levels)::DOUBLE / count(*) AS avg_stock_level,
  count(DISTINCT sku) AS num_skus, count(DISTINCT supplier_name) AS num_suppliers
FROM v_supply GROUP BY ALL
"""
VIEWS["v_joined"] = """
SELECT s.*, ifnull(lead_time, 0) AS lead_time, ifnull(current_stock, 0) AS current_stock,
  ifnull(reorder_point, 0) AS reorder_point, ifnull(avg_order, 0) AS avg_order, ifnull(safety_stock, 0) AS safety_stock,
  ifnull(avg_defect_rate, 0) AS avg_defect_rate, ifnull(max_defect_rate, 0) AS max_defect_rate,
  ifnull(avg_shipping_cost, 0) AS avg_shipping_cost, ifnull(avg_shipping_time, 0) AS avg_shipping_time,
  ifnull(sc_avg_lead_time, 0) AS sc_avg_lead_time, ifnull(avg_stock_level, 0) AS avg_stock_level,
  ifnull(num_skus, 0) AS num_skus, ifnull(num_suppliers, 0) AS num_suppliers,
  (lead_time IS NULL)::INT AS lead_time_missing, (current_stock IS NULL)::INT AS stock_missing,
  (avg_defect_rate IS NULL)::INT AS defect_missing, (avg_shipping_cost IS NULL)::INT AS shipping_cost_missing, product_type
FROM v_sales s LEFT JOIN v_stock i USING (product_id)
LEFT JOIN v_types t ON s.department = 'Health and Beauty' AND list_contains(['haircare', 'skincare', 'cosmetics'], t.product_type)
"""
VIEWS["v_retail"] = """
SELECT l_shipdate::DATE AS date, s_nationkey AS store_id, p_size AS product_id,
  sum(l_quantity::DECIMAL(18,2))::DECIMAL(18,2) AS sales, max(l_quantity)::INT AS stock
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
"""
VIEWS["v_inventory_ml"] = """
SELECT r.date, r.store_id, r.product_id::VARCHAR AS product_id, r.sales AS store_sales, r.stock AS store_stock,
  ifnull(lead_time, 0) AS lead_time, ifnull(current_stock, 0) AS current_stock, ifnull(reorder_point, 0) AS reorder_point,
  ifnull(avg_order, 0) AS avg_order, ifnull(safety_stock, 0) AS safety_stock,
  (lead_time IS NULL)::INT AS lead_time_missing, (current_stock IS NULL)::INT AS stock_missing
FROM v_retail r LEFT JOIN v_stock i ON r.product_id::VARCHAR = i.product_id::VARCHAR
"""
VIEWS["v_inventory"] = """
SELECT date, store_id, product_id, store_sales, current_stock, reorder_point, sum(store_sales) OVER f ::DOUBLE AS sales_30d,
  sum(store_sales) OVER f ::DOUBLE / count(store_sales) OVER f AS avg_sales_30d,
  ifnull(stddev_samp(store_sales::DOUBLE) OVER f, 0) AS stddev_sales_30d,
  ifnull(round(current_stock / nullif(avg_order, 0), 2), 0) AS days_inventory_outstanding,
  (current_stock < reorder_point)::INT AS stock_below_reorder, dayofweek(date) + 1 AS day_of_week, month(date) AS month,
  quarter(date) AS quarter, year(date) AS year
FROM v_inventory_ml WINDOW f AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
"""
VIEWS["v_rows"] = f"""
SELECT *, sum(sales) OVER c ::DOUBLE / count(*) OVER c AS avg_order_value_30d, count(*) OVER c AS num_orders_30d,
  avg(lead_time) OVER m AS avg_lead_time_by_mode, avg(is_late_delivery) OVER m AS late_delivery_rate_by_mode,
  shipment_date - order_date AS order_processing_days, {AS_OF} - shipment_date AS days_since_shipment,
  (sales > 300)::INT AS is_high_value, (quantity > 5)::INT AS is_bulk_order, (profit > 0)::INT AS is_profitable,
  round(profit::DOUBLE / nullif(sales::DOUBLE, 0), 3) AS profit_margin, dayofweek(order_date) + 1 AS day_of_week,
  month(order_date) AS month, quarter(order_date) AS quarter, year(order_date) AS year
FROM v_joined WINDOW
  c AS (PARTITION BY customer_id ORDER BY order_date, order_id, product_id, product_type NULLS FIRST
        ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
  m AS (PARTITION BY shipping_mode ORDER BY order_date, order_id, product_id, product_type NULLS FIRST
        ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
"""
VIEWS["v_history"] = """
SELECT order_id, order_date, NULL::DATE AS date, shipment_date, shipping_mode, sales, quantity, NULL::DECIMAL(18,2) AS units_sold,
  profit, is_late_delivery, lead_time, avg_lead_time_by_mode, avg_order_value_30d, avg_shipping_cost FROM v_rows
UNION ALL
SELECT NULL, NULL, date, NULL, NULL, NULL, NULL, store_sales, NULL, NULL, NULL, NULL, NULL, NULL FROM v_inventory
"""
VIEWS["v_modes"] = """
SELECT shipping_mode AS mode, count(*) AS orders, avg(is_late_delivery) * 100 AS late_pct FROM v_joined GROUP BY ALL
"""
# cleaned form of the dirty sales file, written directly from the tables
VIEWS["v_clean"] = """
SELECT l_orderkey AS order_id,
  IF(o_orderpriority = '5-LOW' AND l_tax = 0, NULL, o_orderdate::DATE) AS order_date,
  IF(l_linestatus = 'O' AND l_returnflag = 'A', NULL, l_shipdate::DATE) AS shipment_date, l_partkey AS product_id,
  IF(c_mktsegment = 'MACHINERY', -1, o_custkey) AS customer_id,
  IF(c_mktsegment = 'MACHINERY', 'Unknown', c_mktsegment) AS customer_segment,
  IF(l_discount = 0, 0, l_extendedprice) AS sales, IF(l_quantity = 50, 0, l_quantity::INT) AS quantity,
  (l_extendedprice::DECIMAL(18,2) * (0.06::DECIMAL(4,2) - l_discount::DECIMAL(4,2)))::DECIMAL(18,4)::DOUBLE AS profit,
  (l_returnflag = 'R')::INT AS is_late_delivery,
  IF(o_orderpriority = '4-NOT SPECIFIED', 'Unknown', o_orderpriority) AS shipping_mode, r_name AS market,
  IF(p_type = 'PROMO', 'Health and Beauty', p_type) AS department, p_brand AS class
FROM v_lines WHERE l_linenumber < 7
"""
VIEWS["v_sites"] = """
SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'
"""
VIEWS["v_events"] = """
SELECT event_id, ts, user_id AS customer_id, value::DECIMAL(18,2) AS sales,
  coalesce(MAP {'purchase': 'Delivered', 'view': 'In Transit', 'error': 'Delayed', 'click': 'At Risk'}[event_type], 'Returned')
    AS shipment_status,
  CASE WHEN k < 25 THEN 'Same Day' WHEN k < 50 THEN 'First Class' WHEN k < 75 THEN 'Second Class' ELSE 'Standard Class' END
    AS shipping_mode,
  k / 10 AS lead_time, 5.0::DOUBLE AS avg_lead_time_by_mode, (user_id % 7)::DOUBLE AS avg_defect_rate
FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)
"""
VIEWS["v_weeks"] = """
SELECT date_trunc('week', order_date)::DATE AS week_start, sum(quantity)::DECIMAL(18,2) AS actual FROM v_joined GROUP BY ALL
"""
VIEWS["v_smooth"] = """
SELECT *, round(0.5 * actual + 0.3 * ifnull(lag(actual) OVER w, actual) + 0.2 * ifnull(lead(actual) OVER w, actual)) AS forecast
FROM v_weeks WINDOW w AS (ORDER BY week_start)
"""
VIEWS["v_points"] = """
SELECT week_start, strftime(week_start, '%b %-d') AS period, actual::BIGINT AS actual, forecast::BIGINT AS forecast,
  round_even((forecast + band)::DOUBLE, 0)::BIGINT AS upper, round_even(greatest(0, forecast - band)::DOUBLE, 0)::BIGINT AS lower
FROM (SELECT *, greatest(abs(actual - forecast), abs(forecast) * 0.08) AS band FROM v_smooth ORDER BY week_start DESC LIMIT 10)
"""
VIEWS["v_store_weeks"] = """
SELECT date_trunc('week', date)::DATE AS week_start, sum(store_sales)::DOUBLE AS actual, sum(avg_sales_30d) AS forecast,
  sum(stddev_sales_30d) AS uncertainty
FROM v_inventory GROUP BY ALL ORDER BY week_start DESC LIMIT 10
"""
VIEWS["v_store_points"] = """
SELECT week_start, strftime(week_start, '%b %-d') AS period, round_even(actual, 0)::BIGINT AS actual,
  round_even(forecast, 0)::BIGINT AS forecast, round_even(forecast + band, 0)::BIGINT AS upper,
  round_even(greatest(0, forecast - band), 0)::BIGINT AS lower
FROM (SELECT *, greatest(uncertainty, abs(forecast) * 0.08) AS band FROM v_store_weeks)
"""
VIEWS["v_dated"] = """
SELECT order_date AS day, is_late_delivery, shipment_date, lead_time, avg_lead_time_by_mode, profit FROM v_history
  WHERE order_date IS NOT NULL
UNION ALL BY NAME
SELECT date AS day, is_late_delivery, shipment_date, lead_time, avg_lead_time_by_mode, profit FROM v_history WHERE date IS NOT NULL
"""
AT_RISK = "ifnull(is_late_delivery, 0) = 1 AND ifnull(lead_time, 0) > coalesce(avg_lead_time_by_mode, lead_time, 0)"
VIEWS["v_months"] = f"""
SELECT date_trunc('month', day)::DATE AS month_start, count(*) FILTER (ifnull(is_late_delivery, 0) <> 1) AS delivered,
  count(*) FILTER (shipment_date > {AS_OF}) AS in_transit, count(*) FILTER (is_late_delivery = 1) AS delayed,
  count(*) FILTER ({AT_RISK}) AS at_risk, count(*) FILTER (profit < 0) AS returned
FROM v_dated GROUP BY ALL
"""
VIEWS["v_slices"] = """
SELECT lower(strftime(month_start, '%b-%Y')) AS id, month_start, key, value FROM (
  SELECT month_start, delivered, in_transit AS "inTransit", delayed, at_risk AS "atRisk", returned FROM v_months)
UNPIVOT (value FOR key IN (delivered, "inTransit", delayed, "atRisk", returned))
"""
VIEWS["v_days"] = f"""
SELECT shipment_date AS ship_day, count(*) FILTER (is_late_delivery = 0) AS on_time,
  count(*) FILTER (is_late_delivery = 1) AS delayed, count(*) FILTER ({AT_RISK}) AS at_risk FROM v_rows GROUP BY ALL
"""
VIEWS["v_weekdays"] = """
SELECT strftime(ship_day, '%a') AS weekday, avg(on_time) AS on_time, avg(delayed) AS delayed, avg(at_risk) AS at_risk
FROM v_days GROUP BY ALL
"""
VIEWS["v_live"] = """
SELECT count(*) AS total, count(*) FILTER (shipment_status NOT IN ('At Risk', 'Delayed')) AS on_time,
  count(*) FILTER (shipment_status = 'Delayed') AS delayed, count(*) FILTER (shipment_status = 'At Risk') AS at_risk FROM v_events
"""
VIEWS["v_current"] = """
SELECT * FROM v_inventory QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY date DESC) = 1
"""
VIEWS["v_category"] = """
SELECT product_id, coalesce(max(department), max(class), 'General') AS category FROM v_joined GROUP BY ALL
"""
VIEWS["v_items"] = """
SELECT row_number() OVER o AS position, c.product_id AS sku, ifnull(category, 'General') AS category,
  store_id::VARCHAR AS warehouse, current_stock::BIGINT AS stock, reorder_point::BIGINT AS reorder_point,
  CASE WHEN reorder_point <= 0 THEN 'Healthy' WHEN current_stock < 0.8 * reorder_point THEN 'Critical'
    WHEN current_stock < reorder_point THEN 'Low' WHEN current_stock > 2 * reorder_point THEN 'Overstock' ELSE 'Healthy' END AS status,
  round_even(days_inventory_outstanding, 0)::BIGINT AS days_of_cover
FROM v_current c LEFT JOIN v_category m ON c.product_id = m.product_id::VARCHAR
WINDOW o AS (ORDER BY NOT (reorder_point > 0 AND current_stock < reorder_point), current_stock, c.product_id, store_id)
ORDER BY position LIMIT 200
"""
VIEWS["v_insight"] = """
SELECT * FROM (SELECT avg(is_late_delivery) * 100 AS late_pct FROM v_joined),
  (SELECT count(*) FILTER (stock_below_reorder = 1) AS below_reorder,
     count(*) FILTER (reorder_point > 0 AND current_stock > 2 * reorder_point) AS overstocked FROM v_inventory),
  (SELECT avg(avg_defect_rate) AS avg_defect_rate, max(max_defect_rate) AS max_defect_rate FROM v_joined)
"""
VIEWS["v_kpi"] = """
SELECT * FROM (SELECT count(*) AS shipments, count(*) FILTER (is_late_delivery = 1) AS late_shipments,
     avg(1 - is_late_delivery) * 100 AS on_time_pct FROM v_joined),
  (SELECT count(*) FILTER (stock_below_reorder = 1) AS reorder_alerts,
     sum(store_sales)::DOUBLE / nullif(avg(nullif(current_stock, 0)), 0) AS inventory_turns,
     100 - least(100, avg(abs(store_sales::DOUBLE - avg_sales_30d) / nullif(abs(store_sales::DOUBLE), 0)) * 100) AS forecast_accuracy
   FROM v_inventory),
  (SELECT avg(avg_shipping_cost) AS cost_per_order FROM v_joined)
"""
VIEWS["v_risk"] = """
SELECT * FROM (SELECT avg(is_late_delivery) * 100 AS late_probability, avg(late_delivery_rate_by_mode) * 100 AS late_impact,
    avg((profit < 0)::INT) * 100 AS margin_probability FROM v_rows),
  (SELECT avg(stock_below_reorder) * 100 AS stockout_probability,
     avg(abs(stddev_sales_30d) / nullif(abs(avg_sales_30d), 0)) * 100 AS demand_volatility,
     avg((reorder_point > 0 AND current_stock > 2 * reorder_point)::INT) * 100 AS overstock_probability FROM v_inventory),
  (SELECT avg(avg_defect_rate) * 20 AS supplier_probability, max(max_defect_rate) * 20 AS supplier_impact FROM v_joined)
"""
VIEWS["v_matrix"] = """
SELECT category, round_even(p, 0)::BIGINT AS probability, round_even(i, 0)::BIGINT AS impact,
  round_even(p * 0.55::DOUBLE + i * 0.45::DOUBLE, 0)::BIGINT AS exposure
FROM (SELECT category, least(100, greatest(0, p)) AS p, least(100, greatest(0, i)) AS i FROM (
  SELECT 'Supplier Quality' AS category, supplier_probability AS p, supplier_impact AS i FROM v_risk
  UNION ALL SELECT 'Delivery Delay', late_probability, late_impact FROM v_risk
  UNION ALL SELECT 'Demand Shock', demand_volatility, 72 FROM v_risk
  UNION ALL SELECT 'Inventory Stockout', stockout_probability, 84 FROM v_risk
  UNION ALL SELECT 'Margin Pressure', margin_probability, 68 FROM v_risk
  UNION ALL SELECT 'Overstock', overstock_probability, 54 FROM v_risk))
"""
VIEWS["v_shipped"] = """
SELECT *, CASE WHEN is_late_delivery = 1 AND score >= 70 THEN 'At Risk' WHEN is_late_delivery = 1 THEN 'Delayed' ELSE 'Delivered' END
    AS status
FROM (SELECT *, least(100, late_delivery_rate_by_mode * 100
    + IF(avg_lead_time_by_mode <> 0 AND lead_time > avg_lead_time_by_mode, 15, 0) + IF(profit < 0, 10, 0)) AS score FROM v_rows)
"""
VIEWS["v_scored"] = """
SELECT *, round(d::DECIMAL(28,8), 2)::DOUBLE AS delivery_risk, round(a::DECIMAL(28,8), 2)::DOUBLE AS anomaly_risk,
  round((d * 0.6::DOUBLE + a * 0.4::DOUBLE)::DECIMAL(28,8), 2)::DOUBLE AS supply_chain_risk,
  CASE WHEN d * 0.6::DOUBLE + a * 0.4::DOUBLE < 25 THEN 'Low' WHEN d * 0.6::DOUBLE + a * 0.4::DOUBLE <= 60 THEN 'Medium' ELSE 'High' END
    AS risk_category,
  IF(avg_defect_rate > 4.5 OR delay > 6, 'Anomaly', 'Normal') AS anomaly_prediction,
  IF(avg_defect_rate > 4.5 OR delay > 6, -0.15, 0.25)::DOUBLE AS anomaly_score
FROM (SELECT *, least(95, greatest(5, 15 + delay * 12 + (sales::DOUBLE / 1000) * 5)) AS d,
    least(98, greatest(2, avg_defect_rate * 12 + delay * 8)) AS a
  FROM (SELECT *, greatest(0, lead_time - avg_lead_time_by_mode) AS delay FROM v_rows))
"""
VIEWS["v_event_scores"] = """
SELECT *, round(d::DECIMAL(28,8), 2)::DOUBLE AS delivery_risk, round(a::DECIMAL(28,8), 2)::DOUBLE AS anomaly_risk,
  round((d * 0.6::DOUBLE + a * 0.4::DOUBLE)::DECIMAL(28,8), 2)::DOUBLE AS supply_chain_risk,
  CASE WHEN d * 0.6::DOUBLE + a * 0.4::DOUBLE < 25 THEN 'Low' WHEN d * 0.6::DOUBLE + a * 0.4::DOUBLE <= 60 THEN 'Medium' ELSE 'High' END
    AS risk_category
FROM (SELECT *, least(95, greatest(5, 15 + delay * 12 + (sales::DOUBLE / 1000) * 5)) AS d,
    least(98, greatest(2, avg_defect_rate * 12 + delay * 8)) AS a
  FROM (SELECT *, greatest(0, lead_time - avg_lead_time_by_mode) AS delay FROM v_events))
"""
VIEWS["v_lags"] = """
SELECT month_start, demand, lag(demand, 1) OVER w AS lag_1, lag(demand, 2) OVER w AS lag_2, lag(demand, 3) OVER w AS lag_3
FROM (SELECT date_trunc('month', order_date)::DATE AS month_start, sum(quantity)::DOUBLE AS demand FROM v_sales GROUP BY ALL)
WINDOW w AS (ORDER BY month_start)
"""
VIEWS["v_forecasts"] = """
SELECT *, (lag_1 + lag_2 + lag_3) / 3 AS mean3, IF(lag_3 IS NULL, NULL,
  round(greatest(10, (lag_1 + lag_2 + lag_3) / 3 + (lag_1 - lag_3) * 0.15::DOUBLE)::DECIMAL(28,8), 2)::DOUBLE) AS predicted_demand
FROM v_lags
"""


def plain(column: str) -> str:
    return rf"ifnull(regexp_replace((round({column}::DECIMAL(28,10), 4)::DECIMAL(28,4))::VARCHAR, '\.?0+$', ''), 'N/A')"


def fixed(column: str, digits: int) -> str:
    return f"(round({column}::DECIMAL(28,10), {digits})::DECIMAL(28,{digits}))::VARCHAR"


def dollars(column: str) -> str:
    return f"'$' || format('{{:,.2f}}', round({column}::DECIMAL(28,10), 2)::DOUBLE)"


def thousands(column: str) -> str:
    return f"format('{{:,}}', ({column})::BIGINT)"


FRACTIONS = [
    "sales",
    "profit",
    "profit_margin",
    "avg_order_value_30d",
    "avg_lead_time_by_mode",
    "late_delivery_rate_by_mode",
    "avg_shipping_cost",
    "avg_defect_rate",
    "max_defect_rate",
]


def record_field(name: str) -> str:
    if name == "feature_extraction_date":
        return f"({AS_OF})::VARCHAR"
    return plain(name) if name in FRACTIONS else f"ifnull({name}::VARCHAR, 'N/A')"


def statement(body: str) -> str:
    """The body preceded by every named sub-query it needs, in dependency order."""
    found: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in seen:
                seen.add(name)  # a recursive view names itself
                visit(VIEWS[name])
                found.append(name)

    visit(body)
    if not found:
        return body.strip()
    parts = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in found)
    recursive = "RECURSIVE " if "v_fold" in found else ""
    return f"WITH {recursive}{parts}\n{body.strip()}"
