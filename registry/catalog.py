"""Every registered query with its check SQL. Both run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.functions import bands, cleaning, measures, months
from harborline.operators import joins, keep, nearest, rolling
from harborline.plans import answers, demand, gold, inventory, kpis, logistics, models, retrieval, risk, scoring, shipments, silver
from harborline.session import PLAIN_LOCAL, bucketed, dropped, fresh_path, written
from harborline.sources import batches, files, intake, store, tables
from harborline.sources.bindings import order_events
from harborline.streaming import marts
from harborline.streaming import orders as live
from harborline.streaming import recent
from registry.layers import AS_OF, Layers, comparable, digits
from registry.sql import AS_OF as SQL_AS_OF
from registry.sql import AT_RISK, dollars, fixed, record_field, statement, thousands

JOBS: dict[str, Callable[[Layers], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, job: Callable[[Layers], DataFrame], check: str | None = None) -> None:
    JOBS[name] = job
    if check is not None:
        CHECKS[name] = statement(check)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(job):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return comparable(job(Layers(spark, folder)))

        return run

    return {name: runner(job) for name, job in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)


def tally(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))


# --- 2.1 sources, sinks, tables -------------------------------------------------------------------------------------


def _csv_round_trip(L: Layers) -> DataFrame:
    path = fresh_path(L.spark, "raw-inventory")
    L.raw_inventory.write.option("header", True).csv(path)
    return files.read_csv_as_text(L.spark, path)


register(
    "bronze_csv_load",
    _csv_round_trip,
    """
    SELECT IF(p_brand = 'Brand#2', NULL, p_partkey::VARCHAR) AS "product id", IF(p_brand = 'Brand#1', '?', p_size::VARCHAR) AS "avg lead time",
      ((p_partkey * step) % 400)::VARCHAR AS "current stock", IF(p_brand = 'Brand#1', NULL, (p_size * 4)::VARCHAR) AS "reorder point",
      (p_partkey % 7)::VARCHAR AS "avg order qty", (p_size * 2)::VARCHAR AS "safety stock"
    FROM part, (VALUES (37), (11)) steps(step)
    """,
)


def _table_of(L: Layers, df: DataFrame, name: str) -> str:
    path = fresh_path(L.spark, name)
    table = tables.table_name(path.rsplit("/", 1)[1].replace("-", "_"))
    tables.replace_table(df, table, path)
    return table


def _replaced(L: Layers) -> DataFrame:
    table = _table_of(L, L.inventory.limit(1), "replaced")
    tables.replace_table(L.inventory, table, fresh_path(L.spark, table))
    return L.spark.table(table)


def _renamed(L: Layers) -> DataFrame:
    table = _table_of(L, L.inventory, "first_name")
    renamed = table.replace("first", "second")
    tables.rename_table(L.spark, table, renamed)
    return L.spark.table(renamed)


def _listed(L: Layers) -> DataFrame:
    made = [_table_of(L, frame, name) for name, frame in (("listed_stock", L.inventory), ("listed_sales", L.sales))]
    shown = tables.list_tables(L.spark).filter(F.col("tableName").isin(*made))
    label = F.when(F.col("tableName") == made[0], "stock").otherwise("sales")
    counts = tables.row_counts({"silver": {"stock": L.spark.table(made[0]), "sales": L.spark.table(made[1])}})
    return shown.select(label.alias("table")).join(counts, "table")


register("create_or_replace_as", _replaced, "SELECT * FROM v_stock")
register("rename_table", _renamed, "SELECT * FROM v_stock")
register(
    "list_tables",
    _listed,
    """SELECT 'silver' AS layer, 'stock' AS "table", count(*) AS "rows" FROM v_stock UNION ALL SELECT 'silver', 'sales', count(*) FROM v_sales""",
)


def _gold_csv(L: Layers) -> DataFrame:
    path = fresh_path(L.spark, "gold-csv")
    records = L.stored.flat
    records.write.option("header", True).option("compression", "gzip").csv(path)
    back = files.read_typed_csv(L.spark, path, records.schema)
    return back.groupBy("year", "quarter").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("sales").alias("sales"),
        F.sum("profit").alias("profit"),
        F.sum("num_orders_30d").alias("orders_30d"),
        F.max("shipment_date").alias("last_shipment"),
    )


register(
    "gold_csv_scan",
    _gold_csv,
    """SELECT year, quarter, count(*) AS "rows", sum(sales)::DOUBLE AS sales, sum(profit)::DOUBLE AS profit,
    sum(num_orders_30d)::BIGINT AS orders_30d, max(shipment_date)::VARCHAR AS last_shipment FROM v_rows GROUP BY ALL""",
)


def _layer_counts(L: Layers) -> DataFrame:
    raw = written(L.raw_sales, "bronze-sales")
    return tables.row_counts(
        {
            "raw": {"sales_shipment": raw, "inventory_stock": L.raw_inventory, "supply_chain": L.raw_supply},
            "silver": {
                "sales_shipment": silver.sales(raw, counted=True),
                "sales_shipment_rejects": silver.sales_rejects(raw),
                "inventory_stock": silver.inventory_stock(L.raw_inventory, counted=True),
                "supply_chain": silver.supply_chain(L.raw_supply, counted=True),
            },
            "gold": {"sales_ml_clean": L.sales_ml, "inventory_ml_clean": L.inventory_ml},
        }
    )


register(
    "layer_row_counts",
    _layer_counts,
    """
    SELECT 'raw' AS layer, 'sales_shipment' AS "table", count(*) AS "rows" FROM v_lines
    UNION ALL SELECT 'raw', 'inventory_stock', 2 * count(*) FROM part
    UNION ALL SELECT 'raw', 'supply_chain', count(*) FROM lineitem
    UNION ALL SELECT 'silver', 'sales_shipment', count(DISTINCT (order_id, product_id, order_date)) FROM v_clean
      WHERE order_date IS NOT NULL AND shipment_date IS NOT NULL
    UNION ALL SELECT 'silver', 'sales_shipment_rejects', count(*) FROM v_clean WHERE order_date IS NULL OR shipment_date IS NULL
    UNION ALL SELECT 'silver', 'inventory_stock', count(*) FROM part WHERE p_brand <> 'Brand#2'
    UNION ALL SELECT 'silver', 'supply_chain', count(DISTINCT l_partkey) FROM lineitem
    UNION ALL SELECT 'gold', 'sales_ml_clean', count(*) FROM v_joined
    UNION ALL SELECT 'gold', 'inventory_ml_clean', count(*) FROM v_inventory_ml
    """,
)
register(
    "historical_status",
    lambda L: tables.status(L.history),
    "SELECT count(*) AS row_count, max(order_date)::VARCHAR AS latest_date FROM v_history WHERE order_date IS NOT NULL",
)
def _purged(L: Layers, rows: DataFrame, condition: Column, gathered: bool = False) -> DataFrame:
    """The rows stored by month, without those for which the condition is true, read back from storage."""
    path = fresh_path(L.spark, "purged")
    files.write_partitioned(rows, path, gathered=gathered)
    store.delete_rows(L.spark, path, condition, ["part_year", "part_month"])
    return L.spark.read.parquet(path)


register(
    "purge_value",
    lambda L: tally(_purged(L, L.sales_ml_by_month, F.col("profit") == 0, gathered=True), "market", "class"),
    """SELECT market, class, count(*) AS "rows" FROM v_joined WHERE profit IS NULL OR profit <> 0 GROUP BY ALL""",
)
register(
    "purge_usual_value",
    # the blocks of the shipping modes are ranges of days, so a task has rows of few months and needs no further shuffle
    lambda L: tally(_purged(L, L.stored.delivery, F.col("avg_order_value_30d") == 200, gathered=True), "shipping_mode"),
    """SELECT shipping_mode, count(*) AS "rows" FROM v_rows WHERE avg_order_value_30d IS NULL OR avg_order_value_30d <> 200 GROUP BY ALL""",
)


def _partitioned(L: Layers) -> DataFrame:
    path = fresh_path(L.spark, "sales-by-month")
    files.write_partitioned(L.sales_ml_by_month, path, gathered=True)
    back = L.spark.read.parquet(path)
    spring = back.filter((F.col("part_year") == 1997) & (F.col("part_month") == 3))
    return spring.groupBy("market").agg(F.count(F.lit(1)).alias("rows"), F.sum("sales").alias("sales"))


register(
    "parquet_sink_partitioned",
    _partitioned,
    """SELECT market, count(*) AS "rows", sum(sales)::DOUBLE AS sales FROM v_joined
    WHERE date_trunc('month', order_date) = DATE '1997-03-01' GROUP BY ALL""",
)

# --- 2.2 cleaning ---------------------------------------------------------------------------------------------------

register(
    "parse_multi_format_date",
    lambda L: tally(
        L.raw_sales.select(
            cleaning.parse_date(F.col("`order date (DateOrders)`")).alias("order_date"),
            cleaning.parse_date(F.col("`shipping date (DateOrders)`")).isNull().cast("int").alias("no_shipment"),
        ),
        "order_date",
        "no_shipment",
    ),
    """SELECT IF(o_orderpriority = '5-LOW' AND l_tax = 0, NULL, o_orderdate::DATE)::VARCHAR AS order_date,
      (l_linestatus = 'O' AND l_returnflag = 'A')::INT AS no_shipment, count(*) AS "rows" FROM v_lines GROUP BY ALL""",
)
register(
    "safe_cast_default",
    lambda L: L.raw_sales.select(
        F.col("`Product Id`").alias("product_id"),
        cleaning.number_or_zero(F.col("Sales"), "double").alias("sales"),
        cleaning.number_or_zero(F.col("`Order Item Quantity`"), "int").alias("quantity"),
    ),
    """SELECT l_partkey::VARCHAR AS product_id, IF(l_discount = 0, 0, l_extendedprice) AS sales,
      IF(l_quantity = 50, 0, l_quantity::INT) AS quantity FROM v_lines""",
)
register(
    "default_unknown",
    lambda L: tally(
        L.raw_sales.select(
            cleaning.text_or_unknown(F.col("`Customer Segment`")).alias("customer_segment"),
            cleaning.text_or_unknown(F.col("`Shipping Mode`")).alias("shipping_mode"),
        ),
        "customer_segment",
        "shipping_mode",
    ),
    """SELECT IF(c_mktsegment = 'MACHINERY', 'Unknown', c_mktsegment) AS customer_segment,
      IF(o_orderpriority = '4-NOT SPECIFIED', 'Unknown', o_orderpriority) AS shipping_mode, count(*) AS "rows" FROM v_lines GROUP BY ALL""",
)
register(
    "default_customer_id",
    lambda L: tally(L.raw_sales.select(cleaning.customer_or_none(F.col("`Customer Id`")).alias("customer_id")), "customer_id"),
    """SELECT IF(c_mktsegment = 'MACHINERY', -1, o_custkey) AS customer_id, count(*) AS "rows" FROM v_lines GROUP BY ALL""",
)
register(
    "late_flag_normalise",
    lambda L: tally(
        L.raw_sales.select("Market", cleaning.late_flag(F.col("`Delivery Status`")).alias("is_late")), "Market", "is_late"
    ),
    """SELECT r_name AS "Market", (l_returnflag = 'R')::INT AS is_late, count(*) AS "rows" FROM v_lines GROUP BY ALL""",
)
register(
    "required_key_filter",
    lambda L: tally(silver.cleaned_sales(L.raw_sales), "class"),
    """SELECT p_brand AS class, count(*) AS "rows" FROM v_lines WHERE l_linenumber < 7 GROUP BY ALL""",
)
DATED = "order_date IS NOT NULL AND shipment_date IS NOT NULL"
register(
    "silver_sales",
    # bronze is a stored table, not an expression that silver would evaluate once per use
    lambda L: silver.sales(written(L.raw_sales, "bronze-sales")),
    f"""SELECT * REPLACE (order_date::VARCHAR AS order_date, shipment_date::VARCHAR AS shipment_date) FROM v_clean WHERE {DATED}
    QUALIFY row_number() OVER (PARTITION BY order_id, product_id, order_date ORDER BY shipment_date DESC,
      customer_id DESC, customer_segment DESC, sales DESC, quantity DESC, profit DESC, is_late_delivery DESC,
      shipping_mode DESC, market DESC, department DESC, class DESC) = 1""",
)
register(
    "silver_sales_rejects",
    lambda L: silver.sales_rejects(L.raw_sales),
    f"""SELECT * REPLACE (order_date::VARCHAR AS order_date, shipment_date::VARCHAR AS shipment_date) FROM v_clean WHERE NOT ({DATED})""",
)
register(
    "silver_inventory_stock",
    lambda L: silver.inventory_stock(L.raw_inventory),
    """SELECT p_partkey AS product_id, IF(p_brand = 'Brand#1', 0, p_size) AS lead_time,
      greatest((p_partkey * 37) % 400, (p_partkey * 11) % 400)::INT AS current_stock, IF(p_brand = 'Brand#1', 0, p_size * 4) AS reorder_point,
      (p_partkey % 7)::INT AS avg_order, p_size * 2 AS safety_stock FROM part WHERE p_brand <> 'Brand#2'""",
)
SITE = """SELECT 'W' || s_suppkey AS warehouse_id, max(IF(r_name = 'EUROPE', 'Unknown', r_name)) AS region_type,
  max((s_acctbal > 5000)::INT) AS has_wms, max(IF(l_returnflag = 'N', 0, l_quantity::INT)){cast} AS {name} FROM v_sites GROUP BY ALL"""
register(
    "silver_regional_warehouse",
    lambda L: silver.regional_warehouse(L.raw_warehouses("capacity_utilisation_pct")),
    SITE.format(cast="::DOUBLE", name="capacity_utilisation_pct"),
)
register(
    "silver_district_store",
    lambda L: silver.district_store(L.raw_warehouses("warehouse_size_sqm")),
    SITE.format(cast="", name="capacity"),
)
register(
    "silver_national_store",
    lambda L: silver.national_store(L.raw_warehouses("warehouse_size_sqm")),
    SITE.format(cast="", name="capacity"),
)
SUPPLY_CLEAN = """SELECT 'SKU' || l_partkey AS sku, p_type AS product_type, p_retailprice::DECIMAL(18,2)::DOUBLE AS price,
  l_linenumber::INT AS availability, l_quantity::INT AS number_of_products_sold, IF(l_discount = 0, 0, l_extendedprice) AS revenue,
  IF(l_returnflag = 'N', 'Unknown', l_returnflag) AS customer_demographics, l_quantity::INT AS stock_levels, p_size AS lead_times,
  l_quantity::INT AS order_quantities, l_linenumber::INT AS shipping_times, IF(l_linestatus = 'F', 'Carrier F', 'Unknown') AS shipping_carriers,
  l_tax::DECIMAL(4,2)::DOUBLE AS shipping_costs, s_name AS supplier_name, n_name AS location, l_discount::DECIMAL(4,2)::DOUBLE AS defect_rates
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
register(
    "silver_supply_chain",
    lambda L: silver.supply_chain(L.raw_supply),
    f"""SELECT * FROM ({SUPPLY_CLEAN}) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY revenue DESC, product_type DESC, price DESC,
      availability DESC, number_of_products_sold DESC, customer_demographics DESC, stock_levels DESC, lead_times DESC,
      order_quantities DESC, shipping_times DESC, shipping_carriers DESC, shipping_costs DESC, supplier_name DESC, location DESC,
      defect_rates DESC) = 1""",
)
RETAIL_CLEAN = """SELECT IF(l_returnflag = 'R' AND l_tax = 0, NULL, l_shipdate::DATE) AS date, 'S' || s_nationkey AS store_id,
  'P' || l_partkey AS product_id, l_quantity AS sales, l_linenumber::INT AS stock FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
RETAIL_FIRST = f"""SELECT * REPLACE (date::VARCHAR AS date) FROM ({RETAIL_CLEAN}) WHERE date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY store_id, product_id, date ORDER BY sales DESC, stock DESC) = 1"""
register("silver_retail_inventory", lambda L: silver.retail_inventory(L.raw_retail), RETAIL_FIRST)
register(
    "month_range_filter",
    lambda L: tally(L.sales.filter(months.in_month(F.col("order_date"), "dec-1997")), "order_date"),
    """SELECT order_date::VARCHAR AS order_date, count(*) AS "rows" FROM v_sales WHERE year(order_date) = 1997 AND month(order_date) = 12 GROUP BY ALL""",
)


def _month_ids(L: Layers) -> DataFrame:
    day, urgency = F.col("o_orderdate"), F.col("o_orderpriority")
    text = (
        F.when(urgency == "1-URGENT", F.date_format(day, "MMM-yyyy"))
        .when(urgency == "2-HIGH", F.upper(F.date_format(day, "MMMM yyyy")))
        .when(urgency == "3-MEDIUM", F.date_format(day, "yyyy/MM"))
        .when(urgency == "5-LOW", F.lower(F.date_format(day, "MMM_yyyy")))
        .otherwise(F.lit("all"))
    )
    return tally(L.table("orders").select(months.month_start_column(text).alias("month_start")), "month_start")


register(
    "month_id_parse",
    _month_ids,
    """SELECT IF(o_orderpriority = '4-NOT SPECIFIED', NULL, date_trunc('month', o_orderdate)::DATE)::VARCHAR AS month_start,
      count(*) AS "rows" FROM orders GROUP BY ALL""",
)
register(
    "date_column_by_year",
    lambda L: tally(L.history.select(F.coalesce("order_date", months.date_column("jan-2024")).alias("day")), "day"),
    """SELECT coalesce(order_date, date)::VARCHAR AS day, count(*) AS "rows" FROM v_history GROUP BY ALL""",
)
register(
    "numeric_or_default",
    lambda L: tally(
        L.raw_sales.select(
            measures.number_or_default(L.raw_sales, "Sales", 100.0).alias("sales"),
            measures.number_or_default(L.raw_sales, "Freight", 5.0).alias("freight"),
        ),
        "sales",
        "freight",
    ),
    """SELECT IF(l_discount = 0, 100, l_extendedprice) AS sales, 5.0::DOUBLE AS freight, count(*) AS "rows" FROM v_lines GROUP BY ALL""",
)


def _scopes(L: Layers) -> DataFrame:
    records = L.sales_ml.withColumn("year", F.year("order_date")).withColumn("quarter", F.quarter("order_date"))
    held = answers.in_scope(records, 1997, 2).agg(F.count(F.lit(1)).alias("rows"), F.sum("sales").alias("sales"))
    empty = answers.in_scope(records, 2050).agg(F.count(F.lit(1)).alias("rows"), F.sum("sales").alias("sales"))
    return held.withColumn("scope", F.lit("q2 1997")).unionByName(empty.withColumn("scope", F.lit("2050")))


register(
    "time_scope_filter",
    _scopes,
    """SELECT 'q2 1997' AS scope, count(*) AS "rows", sum(sales)::DOUBLE AS sales FROM v_joined WHERE year(order_date) = 1997 AND quarter(order_date) = 2
    UNION ALL SELECT '2050', count(*), sum(sales)::DOUBLE FROM v_joined""",
)

# --- 2.3 deduplication ----------------------------------------------------------------------------------------------

ISO_SALES = "SELECT * REPLACE (order_date::VARCHAR AS order_date, shipment_date::VARCHAR AS shipment_date, sales::DOUBLE AS sales, profit::DOUBLE AS profit)"
register("dedup_sales", lambda L: L.sales, f"{ISO_SALES} FROM v_sales")
register(
    "dedup_inventory",
    lambda L: silver.dedup_inventory(
        L.all_supply.select(F.col("sku").alias("product_id"), F.col("stock_levels").alias("current_stock"), "lead_times")
    ),
    "SELECT sku AS product_id, max(stock_levels) AS current_stock, max(lead_times) AS lead_times FROM v_all_supply GROUP BY ALL",
)
for _name, _measure in (("dedup_regional_wh", "capacity_utilisation_pct"), ("dedup_district", "capacity"), ("dedup_national", "capacity")):
    register(
        _name,
        lambda L, measure=_measure: silver.dedup_warehouse(
            L.table("lineitem").select(F.col("l_suppkey").alias("warehouse_id"), F.col("l_extendedprice").alias(measure)), measure
        ),
        f"SELECT l_suppkey AS warehouse_id, max(l_extendedprice) AS {_measure} FROM lineitem GROUP BY ALL",
    )
register(
    "dedup_supply_chain",
    lambda L: L.supply,
    """SELECT * REPLACE (revenue::DOUBLE AS revenue, shipping_costs::DOUBLE AS shipping_costs, defect_rates::DOUBLE AS defect_rates) FROM v_supply""",
)
register(
    "dedup_retail",
    lambda L: silver.dedup_retail(
        L.raw_retail.select(
            cleaning.parse_date(F.col("Date"), None).alias("date"),
            F.col("`Store ID`").alias("store_id"),
            F.col("`Product ID`").alias("product_id"),
            F.col("`Units Sold`").cast("double").alias("sales"),
            F.col("`Inventory Level`").cast("int").alias("stock"),
        ).dropna(subset=["date"])
    ),
    RETAIL_FIRST,
)
CURRENT = """SELECT product_id, store_id, date::VARCHAR AS date, current_stock, reorder_point, days_inventory_outstanding FROM v_current"""
register("latest_inventory", lambda L: inventory.latest_inventory(L.inventory_features), CURRENT)

# --- 2.4 joins ------------------------------------------------------------------------------------------------------

register(
    "join_sales_inventory",
    lambda L: joins.with_stock(L.sales.select("order_id", "product_id", "sales"), L.inventory),
    "SELECT order_id, product_id, sales::DOUBLE AS sales, v_stock.* EXCLUDE (product_id) FROM v_sales LEFT JOIN v_stock USING (product_id)",
)
register(
    "join_supply_chain_theta",
    lambda L: joins.with_supplier_statistics(
        L.sales.select("order_id", "product_id", "department"), gold.supplier_statistics(L.supply)
    ),
    """SELECT order_id, product_id, department, v_types.* FROM v_sales LEFT JOIN v_types
      ON department = 'Health and Beauty' AND product_type IN ('haircare', 'skincare', 'cosmetics')""",
)
register(
    "join_retail_inventory",
    lambda L: joins.with_stock_by_text(L.retail, L.inventory),
    """SELECT r.product_id::VARCHAR AS product_id, r.date::VARCHAR AS date, r.store_id, r.sales::DOUBLE AS sales, r.stock,
      i.* EXCLUDE (product_id) FROM v_retail r LEFT JOIN v_stock i ON r.product_id::VARCHAR = i.product_id::VARCHAR""",
)
register(
    "join_inventory_category",
    lambda L: inventory.with_category(
        inventory.latest_inventory(L.inventory_features).select("product_id", "store_id"), inventory.product_meta(L.sales_ml)
    ),
    "SELECT c.product_id, c.store_id, m.category FROM v_current c LEFT JOIN v_category m ON c.product_id = m.product_id::VARCHAR",
)
register(
    "cross_join_scalars",
    lambda L: keep.side_by_side(
        L.sales.agg(F.count(F.lit(1)).alias("orders")),
        L.inventory.agg(F.sum("current_stock").alias("stock")),
        L.supply.agg(F.max("defect_rates").alias("worst_defect")),
    ),
    """SELECT (SELECT count(*) FROM v_sales) AS orders, (SELECT sum(current_stock)::BIGINT FROM v_stock) AS stock,
      (SELECT max(defect_rates)::DOUBLE FROM v_supply) AS worst_defect""",
)
OVERLAY = f"""
SELECT day, sum(on_time)::BIGINT AS on_time, sum(delayed)::BIGINT AS delayed, sum(at_risk)::BIGINT AS at_risk, calendar_day FROM (
  SELECT calendar_day::DATE::VARCHAR AS calendar_day, strftime(calendar_day, '%a') AS day,
    round_even(ifnull(on_time, 0), 0) AS on_time, round_even(ifnull(delayed, 0), 0) AS delayed, round_even(ifnull(at_risk, 0), 0) AS at_risk
  FROM (SELECT {SQL_AS_OF} - back::INT AS calendar_day FROM range(7) r(back)) LEFT JOIN v_weekdays ON weekday = strftime(calendar_day, '%a')
  UNION ALL SELECT ({SQL_AS_OF})::VARCHAR, strftime({SQL_AS_OF}, '%a'), on_time, delayed, at_risk FROM v_live) GROUP BY ALL
"""
register(
    "history_live_overlay",
    lambda L: logistics.weekday_calendar(logistics.shipment_volume_weekday(L.delivery), AS_OF, shipments.live_counts(L.events)),
    OVERLAY,
)

# --- 2.5 aggregations -----------------------------------------------------------------------------------------------

register("supply_chain_agg", lambda L: gold.supplier_statistics(L.supply), "SELECT * FROM v_types")
register("product_meta", lambda L: inventory.product_meta(L.sales_ml), "SELECT * FROM v_category")
register("kpi_delivery", lambda L: kpis.delivery_kpis(L.delivery), "SELECT shipments, late_shipments, on_time_pct FROM v_kpi")
register(
    "kpi_inventory",
    lambda L: digits(kpis.inventory_kpis(L.inventory_features), 6, "forecast_accuracy"),
    "SELECT reorder_alerts, inventory_turns, round(forecast_accuracy, 6) AS forecast_accuracy FROM v_kpi",
)
register(
    "kpi_cost",
    lambda L: digits(kpis.cost_kpis(L.sales_ml), 6, "cost_per_order"),
    "SELECT round(cost_per_order, 6) AS cost_per_order FROM v_kpi",
)
KPI = f"""
SELECT 'k1' AS id, 'On-Time Delivery' AS label, round(on_time_pct, 6) AS value, 'Gold delivery features' AS hint FROM v_kpi
UNION ALL SELECT 'k2', 'Forecast Accuracy', round(greatest(0, forecast_accuracy), 6), 'Gold inventory features' FROM v_kpi
UNION ALL SELECT 'k3', 'Inventory Turns', round(inventory_turns, 6), 'sales vs. stock' FROM v_kpi
UNION ALL SELECT 'k4', 'Shipments', shipments, {thousands('late_shipments')} || ' late' FROM v_kpi
UNION ALL SELECT 'k5', 'Cost / Order', round(cost_per_order, 6), 'avg shipping cost' FROM v_kpi
UNION ALL SELECT 'k6', 'Open Exceptions', reorder_alerts + late_shipments, 'late + reorder alerts' FROM v_kpi
"""


def kpi_metrics(L: Layers) -> DataFrame:
    return digits(kpis.kpi_metrics(L.delivery, L.inventory_features, L.sales_ml), 6, "value")


register("kpi_metrics", kpi_metrics, KPI)
SUMMARY = """SELECT count(*) AS shipments, count(*) FILTER (is_late_delivery = 1) AS late_shipments,
  avg((ifnull(is_late_delivery, 0) <> 1)::INT) * 100 AS on_time_pct,
  round(100 - least(100, avg(abs(ifnull(sales, 0)::DOUBLE - ifnull(avg_order_value_30d, 0)) / nullif(abs(sales::DOUBLE), 0)) * 100), 6)
    AS forecast_accuracy,
  round(avg(ifnull(avg_shipping_cost, 0)), 6) AS cost_per_order, count(*) FILTER (profit < 0) AS loss_orders,
  max({day})::VARCHAR AS latest_order_date FROM v_history WHERE {where}"""
register(
    "historical_summary",
    lambda L: digits(kpis.historical_summary(L.history, "dec-1997"), 6, "forecast_accuracy", "cost_per_order"),
    SUMMARY.format(day="order_date", where="year(order_date) = 1997 AND month(order_date) = 12"),
)
register(
    "frame_summary",
    lambda L: digits(kpis.frame_summary(L.flat), 6, "forecast_accuracy", "cost_per_order"),
    """SELECT count(*) AS shipments, count(*) FILTER (is_late_delivery = 1) AS late_shipments, avg(1 - is_late_delivery) * 100 AS on_time_pct,
      round(greatest(0, 100 - avg(ifnull(abs(sales::DOUBLE - avg_order_value_30d) / nullif(abs(sales::DOUBLE), 0), 0)) * 100), 6) AS forecast_accuracy,
      round(avg(avg_shipping_cost), 6) AS cost_per_order, count(*) FILTER (profit < 0) AS loss_orders,
      max(order_date)::VARCHAR AS latest_order_date FROM v_rows""",
)
register("late_by_mode", lambda L: kpis.late_by_mode(L.delivery), "SELECT * FROM v_modes ORDER BY late_pct DESC, mode LIMIT 4")
register(
    "riskiest_mode",
    lambda L: kpis.riskiest_mode(L.delivery),
    "SELECT mode AS shipping_mode, late_pct FROM v_modes ORDER BY late_pct DESC, mode LIMIT 1",
)


def insight_metrics(L: Layers) -> DataFrame:
    return kpis.insight_metrics(L.delivery, L.inventory_features, L.sales_ml)


register(
    "insight_metrics",
    lambda L: digits(insight_metrics(L), 6, "avg_defect_rate"),
    "SELECT * REPLACE (round(avg_defect_rate, 6) AS avg_defect_rate) FROM v_insight",
)
UTILISATION = """SELECT 'w' || row_number() OVER o AS id, store_id::VARCHAR AS name,
  round_even(least(100, stock / greatest(capacity, 1) * 100), 0)::BIGINT AS utilisation, greatest(capacity, 1)::BIGINT AS capacity
FROM (SELECT store_id, sum(current_stock) AS stock, sum(current_stock + reorder_point) AS capacity FROM v_inventory GROUP BY ALL)
WINDOW o AS (ORDER BY stock DESC, store_id) ORDER BY stock DESC, store_id LIMIT 8"""
register("warehouse_utilisation", lambda L: kpis.warehouse_utilisation(L.inventory_features), UTILISATION)
STATS = f"""SELECT count(*) AS total, count(*) FILTER (is_late_delivery = 0) AS on_time, count(*) FILTER (is_late_delivery = 1) AS delayed,
  count(*) FILTER ({AT_RISK}) AS at_risk FROM v_rows"""
register("shipment_stats", lambda L: kpis.shipment_stats(L.delivery), STATS)
MONTHS = "SELECT * REPLACE (month_start::VARCHAR AS month_start), lower(strftime(month_start, '%b-%Y')) AS id, strftime(month_start, '%B %Y') AS label FROM v_months"


def monthly(L: Layers) -> DataFrame:
    return logistics.monthly_logistics(logistics.dated_rows(L.history), AS_OF)


NOTES = """(VALUES ('delivered', 'Delivered', 'Arrived without late-delivery flag'),
  ('inTransit', 'In Transit', 'Shipment date is still ahead of today'), ('delayed', 'Delayed', 'Late-delivery flag from Gold delivery features'),
  ('atRisk', 'At Risk', 'Late and above shipping-mode lead-time signal'),
  ('returned', 'Returned', 'Negative-profit orders used as return/loss proxy')) notes(key, name, note)"""
register("monthly_logistics", monthly, MONTHS)
register(
    "logistics_slices",
    lambda L: logistics.logistics_slices(monthly(L)),
    f"SELECT id, month_start::VARCHAR AS month_start, key, name, value, note FROM v_slices JOIN {NOTES} USING (key)",
)
register(
    "slice_share_pct",
    lambda L: logistics.slice_share(logistics.logistics_slices(monthly(L))),
    "SELECT id, key, value, value * 100.0::DOUBLE / sum(value) OVER (PARTITION BY id) AS share_pct FROM v_slices",
)
register(
    "weekly_demand_hist",
    lambda L: demand.weekly_history(L.history),
    "SELECT week_start::VARCHAR AS week_start, actual::DOUBLE AS actual FROM v_weeks",
)
register(
    "weekly_demand_inventory",
    lambda L: digits(demand.weekly_inventory(L.inventory_features), 4, "forecast", "uncertainty"),
    """SELECT week_start::VARCHAR AS week_start, actual, round(forecast, 4) AS forecast, round(uncertainty, 4) AS uncertainty FROM v_store_weeks""",
)
HISTORY = """SELECT date_trunc('month', date)::DATE::VARCHAR AS month_start, strftime(date_trunc('month', date), '%b') AS month,
  count(*) FILTER (reorder_point <= 0 OR current_stock BETWEEN reorder_point AND 2 * reorder_point) AS healthy,
  count(*) FILTER (current_stock < reorder_point AND current_stock >= 0.8 * reorder_point) AS low,
  count(*) FILTER (current_stock < 0.8 * reorder_point) AS critical,
  count(*) FILTER (reorder_point > 0 AND current_stock > 2 * reorder_point) AS overstock
FROM v_inventory GROUP BY ALL ORDER BY month_start DESC LIMIT 7"""
register("inventory_history", lambda L: inventory.status_history(L.inventory_features), HISTORY)
register(
    "shipment_volume_daily",
    lambda L: logistics.shipment_volume_daily(L.delivery),
    """SELECT ship_day::VARCHAR AS ship_day, on_time, delayed, at_risk, strftime(ship_day, '%a') AS day FROM v_days ORDER BY v_days.ship_day DESC LIMIT 7""",
)
register("shipment_volume_weekday", lambda L: logistics.shipment_volume_weekday(L.delivery), "SELECT * FROM v_weekdays")
register(
    "weekday_calendar_fill",
    lambda L: logistics.weekday_calendar(logistics.shipment_volume_weekday(L.delivery), AS_OF),
    f"""SELECT calendar_day::VARCHAR AS calendar_day, strftime(calendar_day, '%a') AS day, round_even(ifnull(on_time, 0), 0)::BIGINT AS on_time,
      round_even(ifnull(delayed, 0), 0)::BIGINT AS delayed, round_even(ifnull(at_risk, 0), 0)::BIGINT AS at_risk
    FROM (SELECT {SQL_AS_OF} - back::INT AS calendar_day FROM range(7) r(back)) LEFT JOIN v_weekdays ON weekday = strftime(calendar_day, '%a')""",
)


def risk_metrics(L: Layers) -> DataFrame:
    return risk.risk_metrics(L.delivery, L.inventory_features, L.sales_ml)


RISK_COLUMNS = [
    "late_probability",
    "late_impact",
    "margin_probability",
    "stockout_probability",
    "demand_volatility",
    "overstock_probability",
    "supplier_probability",
    "supplier_impact",
]
register(
    "risk_metrics",
    lambda L: digits(risk_metrics(L), 6, *RISK_COLUMNS),
    f"SELECT {', '.join(f'round({name}, 6) AS {name}' for name in RISK_COLUMNS)} FROM v_risk",
)
register("risk_matrix", lambda L: risk.risk_matrix(risk_metrics(L)), "SELECT * FROM v_matrix")
register(
    "risk_summary",
    lambda L: risk.risk_summary(risk.risk_matrix(risk_metrics(L))),
    """SELECT count(*) FILTER (exposure > 60) AS high_exposure, round_even(avg(exposure), 0)::BIGINT AS network_risk,
      count(*) FILTER (exposure > 60) + count(*) FILTER (probability > 50) AS anomalies, count(*) FILTER (exposure <= 60) AS resolved FROM v_matrix""",
)
register(
    "risk_trend",
    lambda L: risk.risk_trend(L.delivery),
    """SELECT week_start::VARCHAR AS week_start, risk, strftime(week_start, '%b %-d') AS week FROM (
      SELECT date_trunc('week', order_date)::DATE AS week_start, avg(is_late_delivery) * 100 AS risk FROM v_joined GROUP BY ALL
      ORDER BY week_start DESC LIMIT 8)""",
)
register(
    "regional_performance",
    lambda L: risk.regional_performance(L.delivery),
    """SELECT market AS region, count(*) AS orders, avg(1 - is_late_delivery) * 100 AS on_time_delivery, sum(sales)::DOUBLE AS revenue,
      sum(profit)::DOUBLE AS profit FROM v_joined GROUP BY ALL ORDER BY orders DESC, region LIMIT 8""",
)
register(
    "revenue_trends",
    lambda L: risk.revenue_trends(L.sales_ml),
    """SELECT month_start::VARCHAR AS month_start, revenue, profit, orders, strftime(month_start, '%b %Y') AS period FROM (
      SELECT date_trunc('month', order_date)::DATE AS month_start, sum(sales)::DOUBLE AS revenue, sum(profit)::DOUBLE AS profit,
        count(*) AS orders FROM v_joined GROUP BY ALL ORDER BY month_start DESC LIMIT 12)""",
)
register(
    "critical_sku_count",
    lambda L: inventory.critical_sku_count(L.inventory_features),
    "SELECT count(*) FILTER (reorder_point > 0 AND current_stock < 0.8 * reorder_point) AS critical_skus FROM v_current",
)
RANK_PRODUCT = """SELECT row_number() OVER o AS rank, * FROM (SELECT product_id, sum(sales)::DOUBLE AS total_sales,
  sum(profit)::DOUBLE AS total_profit, count(DISTINCT order_id) AS orders FROM v_rows GROUP BY ALL)
  WINDOW o AS (ORDER BY total_sales DESC, product_id) ORDER BY rank LIMIT 5"""
RANK_DEPARTMENT = """SELECT row_number() OVER o AS rank, department, {cost} AS average_shipping_cost, orders FROM (SELECT department,
  avg(avg_shipping_cost) AS cost, count(DISTINCT order_id) AS orders FROM v_rows GROUP BY ALL)
  WINDOW o AS (ORDER BY cost DESC, department) ORDER BY rank LIMIT 5"""
BY_QUARTER = """SELECT year, quarter, sum(sales)::DOUBLE AS total_sales, sum(profit)::DOUBLE AS total_profit,
  count(DISTINCT order_id) AS orders FROM v_rows GROUP BY ALL"""
LATE_PAIRS = """SELECT row_number() OVER o AS rank, * FROM (SELECT market, department, count(DISTINCT order_id) AS late_orders,
  sum(lead_time)::DOUBLE / count(lead_time) AS average_lead_time FROM v_rows WHERE is_late_delivery = 1 GROUP BY ALL)
  WINDOW o AS (ORDER BY late_orders DESC, market, department) ORDER BY rank LIMIT 10"""
MODE_LEAD = """SELECT row_number() OVER o AS rank, * FROM (SELECT shipping_mode, sum(lead_time)::DOUBLE / count(lead_time) AS average_lead_time,
  count(DISTINCT order_id) AS orders FROM v_rows GROUP BY ALL) WINDOW o AS (ORDER BY average_lead_time DESC, shipping_mode) ORDER BY rank LIMIT 10"""
register("product_sales_rank", lambda L: answers.product_sales_rank(L.flat), RANK_PRODUCT)
register(
    "dept_shipping_cost_rank",
    lambda L: digits(answers.department_shipping_cost(L.flat), 6, "average_shipping_cost"),
    RANK_DEPARTMENT.format(cost="round(cost, 6)"),
)
register("sales_profit_by_quarter", lambda L: answers.sales_profit_by_quarter(L.flat), BY_QUARTER)


def _late_report(records: DataFrame) -> DataFrame:
    total = answers.late_orders(records).agg(F.count(F.lit(1)).alias("all_rows"))
    return answers.late_by_market_department(records).join(total.withColumn("rank", F.lit(1)), "rank", "left")


register(
    "late_by_market_dept",
    lambda L: _late_report(L.flat),
    f"SELECT *, IF(rank = 1, (SELECT count(*) FROM v_rows WHERE is_late_delivery = 1), NULL) AS all_rows FROM ({LATE_PAIRS})",
)
register("lead_time_by_mode", lambda L: answers.lead_time_by_mode(L.flat), MODE_LEAD)


# What the payloads of the overview hold beside ids and numbers, in the order in which the check lists it.
PAYLOAD_TEXTS = ["agent", "label", "title", "summary", "action", "description", "hint", "impact", "confidence", "category", "status", "name", "utilisation", "capacity", "total", "on_time", "delayed", "at_risk"]


def _dashboard(L: Layers) -> DataFrame:
    """The six payloads, taken apart again; order rows and stock rows are stored once for all of them."""
    rows, stock = written(L.stored.rows, "dashboard-orders"), written(L.inventory_features, "dashboard-stock")
    payloads = kpis.as_payload(kpis.dashboard_summary(rows, stock, rows))
    entries = payloads.select("part", F.explode(F.from_json("payload", "array<map<string,string>>")).alias("e"))
    texts = F.concat_ws("|", *(F.col("e")[name] for name in PAYLOAD_TEXTS)).alias("texts")
    return entries.select("part", F.col("e")["id"].alias("id"), texts, F.round(F.col("e")["value"].cast("double"), 6).alias("value"))


# --- 2.6 windows ----------------------------------------------------------------------------------------------------

register(
    "rolling_store_product_30",
    lambda L: digits(
        gold.rolling_store_product(L.inventory_ml).select(
            "date", "store_id", "product_id", "sales_30d", "avg_sales_30d", "stddev_sales_30d"
        ),
        6,
        "stddev_sales_30d",
    ),
    """SELECT date::VARCHAR AS date, store_id, product_id, sales_30d, avg_sales_30d, round(stddev_sales_30d, 6) AS stddev_sales_30d FROM v_inventory""",
)


def _customer_windows(L: Layers) -> DataFrame:
    # low limits, so that large customers are cut within days and small ones take the plain path
    heavy = rolling.heavy_keys(L.sales, ["customer_id"], min_rows=45)
    slices = written(rolling.day_slices(L.table("orders"), "o_orderdate", "o_orderkey", rows=6), "day-slices")
    return gold.rolling_customer(L.joined, heavy, slices).select(
        "order_id", "product_id", "order_date", "avg_order_value_30d", "num_orders_30d"
    )


register(
    "rolling_customer_30",
    _customer_windows,
    "SELECT order_id, product_id, order_date::VARCHAR AS order_date, avg_order_value_30d, num_orders_30d FROM v_rows",
)
register(
    "rolling_mode_30",
    # small blocks of a few days, so that block borders are crossed at every size
    lambda L: gold.rolling_mode(L.joined, written(rolling.day_slices(L.table("orders"), "o_orderdate", "o_orderkey", rows=300), "day-slices")).select(
        "order_id", "product_id", "order_date", "avg_lead_time_by_mode", "late_delivery_rate_by_mode"
    ),
    "SELECT order_id, product_id, order_date::VARCHAR AS order_date, avg_lead_time_by_mode, late_delivery_rate_by_mode FROM v_rows",
)
register(
    "lag_lead_smoothing",
    lambda L: demand.smoothed(demand.weekly_history(L.history)),
    "SELECT week_start::VARCHAR AS week_start, actual::DOUBLE AS actual, forecast::DOUBLE AS forecast FROM v_smooth",
)
register(
    "rn_first",
    lambda L: keep.keep_first(
        L.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderdate").desc()]
    ),
    """SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) = 1""",
)
SOLD = "SELECT product_id, date_trunc('month', order_date)::DATE AS month_start, sum(quantity)::DOUBLE AS demand FROM v_sales GROUP BY ALL"
register(
    "demand_lags",
    lambda L: demand.monthly_lags(L.sales, ["product_id"]),
    f"""SELECT product_id, month_start::VARCHAR AS month_start, demand, lag(demand, 1) OVER w AS lag_1, lag(demand, 2) OVER w AS lag_2,
      lag(demand, 3) OVER w AS lag_3, (lag(demand, 1) OVER w + lag(demand, 2) OVER w + lag(demand, 3) OVER w) / 3 AS rolling_mean_3,
      month(month_start) AS month
    FROM (SELECT product_id, month_start, coalesce(demand, 0) AS demand FROM (SELECT product_id,
        unnest(generate_series(min(month_start), max(month_start), INTERVAL 1 MONTH))::DATE AS month_start FROM ({SOLD}) GROUP BY product_id)
      LEFT JOIN ({SOLD}) USING (product_id, month_start)) m
    WINDOW w AS (PARTITION BY product_id ORDER BY m.month_start)""",
)

# --- 2.7 top-k ------------------------------------------------------------------------------------------------------

register(
    "topn_then_reverse",
    lambda L: keep.latest(L.sales.groupBy("order_date").agg(F.sum("sales").alias("sales")), "order_date", 12),
    "SELECT order_date::VARCHAR AS order_date, sum(sales)::DOUBLE AS sales FROM v_sales GROUP BY v_sales.order_date ORDER BY v_sales.order_date DESC LIMIT 12",
)
REPLENISH = f"""SELECT 'd' || place AS id, title, description, status FROM (SELECT row_number() OVER o AS place, 'Review replenishment for ' || product_id AS title,
  store_id || ' has ' || {thousands('current_stock')} || ' units against a reorder point of ' || {thousands('reorder_point')} || '.' AS description,
  'review' AS status FROM v_inventory WHERE stock_below_reorder = 1
  WINDOW o AS (ORDER BY current_stock, reorder_point DESC, product_id, store_id, date)) WHERE place <= 4"""
register("replenishment_candidates", lambda L: kpis.replenishment_candidates(L.inventory_features), REPLENISH)
register("inventory_items", lambda L: inventory.items(L.inventory_features, L.sales_ml), "SELECT * FROM v_items")
SHIPPED = """SELECT row_number() OVER o AS position, 'ORD-' || order_id AS id, market AS origin, customer_segment AS destination,
  shipping_mode AS carrier, status, shipment_date::VARCHAR AS eta, 100 AS progress, round_even(score, 0)::BIGINT AS risk_score FROM v_shipped
  WINDOW o AS (ORDER BY shipment_date DESC, order_id, product_id, order_date, avg_lead_time_by_mode, late_delivery_rate_by_mode)
  ORDER BY position LIMIT 100"""
register("latest_shipments", lambda L: shipments.latest_shipments(L.delivery), SHIPPED)
BULK = """SELECT row_number() OVER o AS rank, order_id, product_id, quantity, sales::DOUBLE AS sales, profit::DOUBLE AS profit, profit_margin
  FROM v_rows WHERE quantity > 5 AND profit <= 0 WINDOW o AS (ORDER BY profit, sales, order_id, product_id) ORDER BY rank LIMIT 10"""


def _bulk_report(records: DataFrame) -> DataFrame:
    total = answers.unprofitable_bulk_orders(records).agg(F.count(F.lit(1)).alias("all_rows"))
    return answers.lowest_profit_bulk_orders(records).join(total.withColumn("rank", F.lit(1)), "rank", "left")


register(
    "unprofitable_bulk_orders",
    lambda L: _bulk_report(_records(L)),
    f"SELECT *, IF(rank = 1, (SELECT count(*) FROM v_rows WHERE quantity > 5 AND profit <= 0), NULL) AS all_rows FROM ({BULK})",
)
LONGEST = """SELECT row_number() OVER o AS rank, order_id, product_id, lead_time, shipping_mode FROM v_rows
  WINDOW o AS (ORDER BY lead_time DESC, order_id, product_id) ORDER BY rank LIMIT 5"""
LARGEST = """SELECT row_number() OVER o AS rank, order_id, product_id, quantity, sales::DOUBLE AS sales FROM v_rows
  WINDOW o AS (ORDER BY quantity DESC, order_id, product_id, sales) ORDER BY rank LIMIT 5"""
register("longest_lead_orders", lambda L: answers.longest_lead_orders(L.flat), LONGEST)
register("largest_quantity_orders", lambda L: answers.largest_quantity_orders(L.flat), LARGEST)
register(
    "order_lookup",
    lambda L: answers.order_lookup(
        L.flat, L.table("orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("order_id"))
    ),
    """SELECT order_id, product_id, order_date::VARCHAR AS order_date, shipment_date::VARCHAR AS shipment_date, sales::DOUBLE AS sales, quantity,
      profit::DOUBLE AS profit, shipping_mode, lead_time, is_late_delivery FROM v_rows
    WHERE order_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
)

# --- 2.8 unions -----------------------------------------------------------------------------------------------------

register(
    "union_date_sources",
    lambda L: tally(logistics.dated_rows(L.history), "dashboard_date"),
    """SELECT day::VARCHAR AS dashboard_date, count(*) AS "rows" FROM v_dated GROUP BY ALL""",
)
FEED = f"""SELECT 'a' || place AS id, agent, action, status FROM (SELECT row_number() OVER o AS place, agent, action, status FROM (
  SELECT 'Logistics' AS agent, mode || ' late-delivery rate is ' || {fixed('late_pct', 1)} || '% across ' || orders || ' orders' AS action,
    IF(late_pct > 25, 'warning', 'success') AS status, late_pct / 100 AS sort_score FROM v_modes
  UNION ALL SELECT 'Inventory', below_reorder || ' product-store pairs are below reorder point', IF(below_reorder > 0, 'warning', 'success'),
    below_reorder FROM v_insight) WINDOW o AS (ORDER BY sort_score DESC, action)) WHERE place <= 6"""
register("activity_feed", lambda L: kpis.activity_feed(L.delivery, L.inventory_features), FEED)
register(
    "historical_activity_feed",
    lambda L: kpis.historical_activity_feed(L.history.filter(F.col("order_date").isNotNull())),
    f"""SELECT 'a' || row_number() OVER o AS id, 'Logistics' AS agent, mode || ' late-delivery rate is ' || {fixed('late_pct', 1)}
      || '% across ' || {thousands('orders')} || ' orders' AS action, IF(late_pct > 25, 'warning', 'success') AS status FROM v_modes
    WINDOW o AS (ORDER BY late_pct DESC, mode) ORDER BY id LIMIT 4""",
)
LIVE_ROWS = """SELECT 0 AS part, 'LIVE-' || event_id AS id, 'Live network' AS origin, customer_id::VARCHAR AS destination, shipping_mode AS carrier,
  shipment_status AS status, 'Live now' AS eta, MAP {'Delivered': 100, 'In Transit': 72, 'Delayed': 46, 'At Risk': 46, 'Returned': 46}[shipment_status] AS progress,
  round_even(supply_chain_risk, 0)::BIGINT AS risk_score, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sort_ts FROM v_event_scores"""
register(
    "live_plus_history_rows",
    lambda L: shipments.live_then_history(
        shipments.live_records(scoring.score_risk(L.events)), shipments.latest_shipments(L.delivery)
    ),
    f"{LIVE_ROWS.replace(' FROM v_event_scores', ', NULL::BIGINT AS position FROM v_event_scores')} UNION ALL BY NAME SELECT 1 AS part, * FROM ({SHIPPED})",
)

# --- 2.9 scalar rules and 2.10 derived features ----------------------------------------------------------------------

GOLD_SALES = """SELECT * EXCLUDE (product_type) REPLACE (order_date::VARCHAR AS order_date, shipment_date::VARCHAR AS shipment_date,
  sales::DOUBLE AS sales, profit::DOUBLE AS profit) FROM v_joined"""
register("gold_sales_ml_clean", lambda L: L.sales_ml, GOLD_SALES)
register(
    "gold_inventory_ml_clean",
    lambda L: L.inventory_ml,
    "SELECT * REPLACE (date::VARCHAR AS date, store_sales::DOUBLE AS store_sales) FROM v_inventory_ml",
)
register(
    "gold_inventory_features",
    lambda L: digits(L.inventory_features, 6, "stddev_sales_30d"),
    f"""SELECT * REPLACE (date::VARCHAR AS date, store_sales::DOUBLE AS store_sales, round(stddev_sales_30d, 6) AS stddev_sales_30d),
      strftime({SQL_AS_OF}, '%Y-%m-%d 00:00:00') AS created_at, ({SQL_AS_OF})::VARCHAR AS feature_date FROM v_inventory""",
)
DELIVERY_SQL = ", ".join(
    {
        "order_date": "order_date::VARCHAR AS order_date",
        "shipment_date": "shipment_date::VARCHAR AS shipment_date",
        "sales": "sales::DOUBLE AS sales",
        "profit": "profit::DOUBLE AS profit",
        "created_at": f"strftime({SQL_AS_OF}, '%Y-%m-%d 00:00:00') AS created_at",
        "feature_date": f"({SQL_AS_OF})::VARCHAR AS feature_date",
        "feature_extraction_date": f"({SQL_AS_OF})::VARCHAR AS feature_extraction_date",
    }.get(name, name)
    for name in gold.DELIVERY
)
register("gold_delivery_features", lambda L: L.stored.delivery, f"SELECT {DELIVERY_SQL} FROM v_rows")
COMBINED_SQL = ", ".join({"sales": "sales::DOUBLE AS sales", "profit": "profit::DOUBLE AS profit"}.get(n, n) for n in gold.COMBINED)
register(
    "gold_combined_features",
    lambda L: gold.combined_features(L.stored.delivery, AS_OF),
    f"SELECT {COMBINED_SQL}, ({SQL_AS_OF})::VARCHAR AS feature_extraction_date FROM v_rows",
)
FLAT_SQL = ", ".join(
    {
        "order_date": "order_date::VARCHAR AS order_date",
        "shipment_date": "shipment_date::VARCHAR AS shipment_date",
        "sales": "sales::DOUBLE AS sales",
        "profit": "profit::DOUBLE AS profit",
        "feature_extraction_date": f"({SQL_AS_OF})::VARCHAR AS feature_extraction_date",
    }.get(name, name)
    for name in gold.FLAT_RECORD
)
register("flat_order_record", lambda L: L.stored.flat, f"SELECT {FLAT_SQL} FROM v_rows")
register(
    "gold_integrated",
    lambda L: L.history.select(
        "order_id", "order_date", "date", "shipment_date", "shipping_mode", "sales", "quantity", "units_sold", "profit", "lead_time"
    ),
    """SELECT order_id, order_date::VARCHAR AS order_date, date::VARCHAR AS date, shipment_date::VARCHAR AS shipment_date, shipping_mode,
      sales::DOUBLE AS sales, quantity, units_sold::DOUBLE AS units_sold, profit::DOUBLE AS profit, lead_time FROM v_history""",
)
register(
    "stock_status",
    lambda L: L.inventory.select(
        "product_id", "current_stock", "reorder_point", bands.stock_status(F.col("current_stock"), F.col("reorder_point")).alias("status")
    ),
    """SELECT product_id, current_stock, reorder_point, CASE WHEN reorder_point <= 0 THEN 'Healthy' WHEN 10 * current_stock < 8 * reorder_point THEN 'Critical'
      WHEN current_stock < reorder_point THEN 'Low' WHEN current_stock > 2 * reorder_point THEN 'Overstock' ELSE 'Healthy' END AS status FROM v_stock""",
)
register(
    "shipment_risk_score",
    lambda L: shipments.scored(L.delivery).select("order_id", "product_id", "shipment_date", "risk_score", "status"),
    "SELECT order_id, product_id, shipment_date::VARCHAR AS shipment_date, score AS risk_score, status FROM v_shipped",
)
GRADE = "CASE WHEN {v} > {a} THEN 'High' WHEN {v} > {b} THEN 'Medium' ELSE 'Low' END"
INSIGHTS = f"""
    SELECT 'i1' AS id, 'Delivery pressure' AS title, (SELECT mode || ' shipping has the highest late-delivery signal at ' || {fixed('late_pct', 1)} || '%.'
        FROM v_modes ORDER BY v_modes.late_pct DESC, mode LIMIT 1) AS summary, late_pct AS value,
      CASE WHEN late_pct >= 30 THEN 'High' WHEN late_pct >= 15 THEN 'Medium' ELSE 'Low' END AS impact,
      round_even(least(96, greatest(55, 100 - late_pct / 2)), 0)::BIGINT AS confidence, 'Logistics' AS category FROM v_insight
    UNION ALL SELECT 'i2', 'Reorder exposure', {thousands('below_reorder')} || ' product-store pairs are below reorder point in the Gold inventory features.',
      below_reorder, {GRADE.format(v='below_reorder', a=50, b=0)}, 88, 'Inventory' FROM v_insight
    UNION ALL SELECT 'i3', 'Working capital watch', {thousands('overstocked')} || ' product-store pairs are above twice their reorder point.',
      overstocked, IF(overstocked > 0, 'Medium', 'Low'), 82, 'Inventory' FROM v_insight
    UNION ALL SELECT 'i4', 'Supplier quality signal', 'Maximum defect signal maps to a ' || round_even(d, 0)::BIGINT || '/100 quality-risk score.',
      d, {GRADE.format(v='d', a=70, b=40)}, 79, 'Risk' FROM (SELECT least(100, greatest(0, max_defect_rate * 20)) AS d FROM v_insight)"""
register(
    "insight_severity",
    lambda L: kpis.insight_severity(insight_metrics(L), kpis.riskiest_mode(L.delivery)),
    INSIGHTS,
)
register(
    "historical_insights",
    lambda L: kpis.historical_insights(kpis.historical_summary(L.history)),
    f"""SELECT 'i1' AS id, 'Historical delivery pressure' AS title, on_time_pct AS value, {GRADE.format(v='late_shipments', a=1000, b=0)} AS impact,
      'Logistics' AS category FROM ({SUMMARY.format(day='order_date', where='order_date IS NOT NULL')})
    UNION ALL SELECT 'i2', 'Margin pressure', loss_orders, {GRADE.format(v='loss_orders', a=50, b=0)}, 'Demand'
      FROM ({SUMMARY.format(day='order_date', where='order_date IS NOT NULL')})""",
)
register(
    "forecast_band",
    lambda L: demand.with_band(demand.smoothed(demand.weekly_history(L.history))),
    """SELECT week_start::VARCHAR AS week_start, actual::DOUBLE AS actual, forecast::DOUBLE AS forecast, (forecast + band)::DOUBLE AS upper,
      greatest(0, forecast - band)::DOUBLE AS lower FROM (SELECT *, greatest(abs(actual - forecast), abs(forecast) * 0.08) AS band FROM v_smooth)""",
)
POINT_SUMS = """SELECT sum(abs(forecast - actual)) FILTER (actual <> 0) AS miss, sum(actual) FILTER (actual <> 0) AS total,
  sum(forecast - actual) FILTER (actual <> 0 AND back <= {recent}) AS gap, sum(actual) FILTER (actual <> 0 AND back <= {recent}) AS base,
  max(upper) FILTER (back = 1) AS up, max(forecast) FILTER (back = 1) AS last, count(*) AS points
FROM (SELECT *, row_number() OVER (ORDER BY week_start DESC) AS back FROM {view})"""
INTELLIGENCE = f"""SELECT least(100, greatest(0, 100 - miss::DOUBLE / total * 100)) AS accuracy,
  least(100, greatest(-100, gap::DOUBLE / base * 100)) AS demand_delta,
  CASE WHEN up > last * 1.25 THEN 'High' WHEN up > last * 1.1 THEN 'Medium' ELSE 'Low' END AS demand_risk, points FROM ({POINT_SUMS})"""
HIST = INTELLIGENCE.format(recent=3, view="v_points")
STORE = INTELLIGENCE.format(recent=1, view="v_store_points")
register(
    "forecast_accuracy_series",
    lambda L: demand.accuracy(demand.history_points(L.history)),
    f"SELECT accuracy FROM ({HIST})",
)
register(
    "demand_delta",
    lambda L: demand.intelligence_history(L.history).select("demand_delta"),
    f"SELECT demand_delta FROM ({HIST})",
)
register(
    "demand_risk_band",
    lambda L: demand.history_points(L.history).select(
        "week_start", bands.demand_risk(F.col("upper"), F.col("forecast")).alias("demand_risk")
    ),
    """SELECT week_start::VARCHAR AS week_start, CASE WHEN upper > forecast * 1.25 THEN 'High' WHEN upper > forecast * 1.1 THEN 'Medium'
      ELSE 'Low' END AS demand_risk FROM v_points""",
)
register("demand_intelligence_hist", lambda L: demand.intelligence_history(L.history), HIST)
register("demand_intelligence_inventory", lambda L: demand.intelligence_inventory(L.inventory_features), STORE)
register(
    "exposure_band",
    lambda L: risk.with_exposure_band(risk.risk_matrix(risk_metrics(L))),
    "SELECT *, CASE WHEN exposure > 60 THEN 'high' WHEN exposure > 45 THEN 'warning' ELSE 'normal' END AS band FROM v_matrix",
)


def _forecasts(L: Layers) -> DataFrame:
    lags = demand.monthly_lags(L.sales).drop("rolling_mean_3", "month")
    points = live.demand_events(lags).dropna(subset=["predicted_demand"])
    return points.withColumn("period", F.date_format("month_start", "MMM yyyy"))


register(
    "live_forecast_overlay",
    lambda L: demand.live_overlay(demand.history_points(L.history), _forecasts(L)),
    """
    SELECT 0 AS part, period, actual::DOUBLE AS actual, forecast::DOUBLE AS forecast, upper::DOUBLE AS upper, lower::DOUBLE AS lower,
      (upper - lower)::DOUBLE AS spread, NULL::DOUBLE AS live_demand FROM v_points
    UNION ALL SELECT 1, strftime(month_start, '%b %Y'), NULL, round(mean3::DECIMAL(28,8), 2)::DOUBLE, predicted_demand * 1.08::DOUBLE,
      predicted_demand * 0.92::DOUBLE, predicted_demand * 0.16::DOUBLE, predicted_demand FROM v_forecasts WHERE predicted_demand IS NOT NULL
    """,
)
register(
    "critical_demand_threshold",
    lambda L: demand.above_critical(demand.smoothed(demand.weekly_history(L.history))),
    "SELECT week_start::VARCHAR AS week_start, actual::DOUBLE AS actual, forecast::DOUBLE AS forecast FROM v_smooth WHERE forecast > 5400",
)
register(
    "score_risk_analytic",
    lambda L: scoring.score_risk(L.rows).select("order_id", "product_id", "order_date", *scoring.SCORES),
    f"SELECT order_id, product_id, order_date::VARCHAR AS order_date, {', '.join(scoring.SCORES)} FROM v_scored",
)
register(
    "composite_risk",
    lambda L: scoring.composite_risk(
        L.sales.select(
            "order_id",
            "product_id",
            "order_date",
            (F.col("quantity") * 2.0).alias("delivery_risk"),
            F.when(F.col("is_late_delivery") == 1, 90.0).otherwise(12.5).alias("anomaly_risk"),
        )
    ),
    """SELECT order_id, product_id, order_date::VARCHAR AS order_date, d AS delivery_risk, a AS anomaly_risk,
      round((d * 0.6::DOUBLE + a * 0.4::DOUBLE)::DECIMAL(28,8), 2)::DOUBLE AS supply_chain_risk,
      CASE WHEN d * 0.6::DOUBLE + a * 0.4::DOUBLE < 25 THEN 'Low' WHEN d * 0.6::DOUBLE + a * 0.4::DOUBLE <= 60 THEN 'Medium' ELSE 'High' END AS risk_category
    FROM (SELECT *, quantity * 2::DOUBLE AS d, IF(is_late_delivery = 1, 90, 12.5)::DOUBLE AS a FROM v_sales)""",
)
register(
    "forecast_demand_analytic",
    lambda L: scoring.forecast_demand(demand.monthly_lags(L.sales)).select("month_start", "lag_1", "lag_2", "lag_3", "predicted_demand"),
    "SELECT month_start::VARCHAR AS month_start, lag_1, lag_2, lag_3, predicted_demand FROM v_forecasts",
)


def _by_time(df: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the report date to learn from, later rows to judge by."""
    return df.filter(F.col(day) < F.lit(AS_OF)), df.filter(F.col(day) >= F.lit(AS_OF))


def _delay_model(L: Layers) -> DataFrame:
    read = dict.fromkeys(["order_date", "is_late_delivery", *models.DELAY_TEXT, *models.DELAY_NUMBERS])
    train, later = _by_time(written(L.stored.flat.select(*read), "flat"), "order_date")
    scored = models.predict_delay(models.fit_delay(train), later)
    return scored.groupBy("shipping_mode", "is_late_delivery").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("delivery_risk").alias("mean_delivery_risk")
    )


def _anomaly_model(L: Layers) -> DataFrame:
    read = dict.fromkeys(["order_id", "product_id", *models.ANOMALY_NUMBERS])
    return models.anomaly_risk(written(L.stored.flat.select(*read), "flat")).select("order_id", "product_id", "isolation", "anomaly_risk", "anomaly_prediction")


def _demand_model(L: Layers) -> DataFrame:
    train, later = _by_time(written(demand.monthly_lags(L.sales, ["product_id"]), "lags"), "month_start")
    scored = models.predict_demand(models.fit_demand(train), later)
    return scored.select("product_id", "month_start", "demand", "predicted_demand")


register("ml_delivery_delay", _delay_model)
register("ml_anomaly", _anomaly_model)
register("ml_demand", _demand_model)

# --- 2.11 retrieval -------------------------------------------------------------------------------------------------

LABELS = [name.replace("_", " ").title() for name in gold.FLAT_RECORD]
TEXT_SQL = "concat_ws(chr(10), 'Order record:', " + ", ".join(
    f"'{label}: ' || {record_field(name)}" for label, name in zip(LABELS, gold.FLAT_RECORD)
) + ")"
META_SQL = "concat_ws(';', " + ", ".join(f"'{name}=' || {record_field(name)}" for name in gold.FLAT_RECORD) + ")"
ID_SQL = "'order_' || order_id || '_product_' || product_id"
register("row_to_chunk_text", lambda L: L.stored.flat.select(retrieval.chunk_text(L.stored.flat).alias("text")), f"SELECT {TEXT_SQL} AS text FROM v_rows")


def _metadata_text(column):
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


register(
    "row_to_metadata",
    lambda L: L.stored.flat.select("order_id", "product_id", _metadata_text(retrieval.chunk_metadata(L.stored.flat)).alias("metadata")),
    f"SELECT order_id, product_id, {META_SQL} AS metadata FROM v_rows",
)
register(
    "build_chunks",
    lambda L: retrieval.build_chunks(L.stored.flat).select("id", "text", F.size("metadata").alias("fields")),
    f"SELECT {ID_SQL} AS id, {TEXT_SQL} AS text, 32 AS fields FROM v_rows",
)


def _texts(records: DataFrame) -> DataFrame:
    newest = [retrieval.field_text(records, name).desc() for name in ("order_date", "shipment_date")]
    return retrieval.latest_texts(records, newest)


CHUNKS_SQL = f"""SELECT id, text, shipment_date FROM (SELECT {ID_SQL} AS id, {TEXT_SQL} AS text, order_date, shipment_date FROM v_rows)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY order_date DESC, shipment_date DESC, text DESC) = 1"""


def _upserted(L: Layers) -> DataFrame:
    """A first load with drafts of the older chunks, then a second load that replaces them in storage."""
    path, records = fresh_path(L.spark, "chunks"), written(L.stored.flat, "chunk-records")
    # records are merged; the chunks, which are several times as large, are made of those that count
    chunks = lambda rows: retrieval.build_chunks(rows.select(*records.columns))
    older = retrieval.field_text(records, "shipment_date") < AS_OF.isoformat()
    draft = F.when(F.element_at("metadata", "shipment_date") < AS_OF.isoformat(), F.concat(F.lit("draft of "), "text")).otherwise(F.col("text"))
    newest = [*(retrieval.field_text(records, name).desc() for name in ("order_date", "shipment_date")), retrieval.chunk_text(records).desc()]
    named = records.withColumn("id", retrieval.chunk_id(records))
    store.upsert(L.spark, path, named, newest, ties=[], widen=lambda rows: chunks(rows).withColumn("text", draft))
    store.upsert(L.spark, path, named.where(older), newest, ties=[], widen=chunks)
    return L.spark.read.parquet(path)


register("upsert_chunks", lambda L: _upserted(L).select("id", "text"), f"SELECT id, text FROM ({CHUNKS_SQL})")


EMBED_BATCHES = 16


def _resume(L: Layers) -> DataFrame:
    """A job that ended after half of its batches goes on; a digest of the text stands for its vector."""
    staged, out = fresh_path(L.spark, "chunk-batches"), fresh_path(L.spark, "chunk-vectors")
    records = L.stored.flat
    # all records of a chunk are in its batch; texts are made there, so what is stored and moved are the records
    batches.stage(records.withColumn("id", retrieval.chunk_id(records)), staged, EMBED_BATCHES)
    numbered = batches.batch_of("id", EMBED_BATCHES).alias(batches.BATCH)
    held = []

    def dealt(rows: DataFrame) -> DataFrame:
        """The records of some batches dealt by their id; the table of the batches before them is written out and goes."""
        if held:
            dropped(L.spark, held.pop())
        held.append(bucketed(rows, "batch_records", ["id"], L.stored.buckets))
        return L.spark.table(held[0])

    for attempt, most in ((1, EMBED_BATCHES // 2), (2, None)):
        batches.run(L.spark, staged, out, lambda rows, attempt=attempt: _texts(dealt(rows)).select("id", F.sha2("text", 256).alias("vector"), F.lit(attempt).alias("attempt"), numbered), most=most)
    return L.spark.read.parquet(f"{out}/rows")


register(
    "embed_resume",
    _resume,
    f"""SELECT id, sha256(text) AS vector, IF(dense_rank() OVER (ORDER BY batch) <= {EMBED_BATCHES // 2}, 1, 2) AS attempt, batch::INT AS batch
      FROM (SELECT *, ('0x' || substr(md5(id), 1, 8))::BIGINT % {EMBED_BATCHES} AS batch FROM ({CHUNKS_SQL}))""",
)


SHELVES = 64


def _uploaded(documents: DataFrame, folder: str) -> None:
    """Every document as a text file of its own, in a few folders; rows of one read task with the same id are lines of one file."""
    numbered = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    lines = F.array_sort(F.collect_list(F.struct("row", "text")))
    whole = numbered.groupBy("doc_id", F.shiftright("row", 33).alias("task")).agg(F.array_join(lines["text"], "\n").alias("text"))
    shelf = F.pmod(F.xxhash64("doc_id"), F.lit(SHELVES)).alias("shelf")
    # files are moved to their folders by the tasks that made them
    moved = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
    whole.select("text", shelf).write.mode("append").options(**moved, **PLAIN_LOCAL).partitionBy("shelf").text(folder)


def _ingested(L: Layers) -> DataFrame:
    """Every document as a text file of its own, in two deliveries; a third call finds nothing new."""
    folder, corpus = fresh_path(L.spark, "uploads"), fresh_path(L.spark, "uploaded")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    taken = []
    for delivery in (english, ~english):
        _uploaded(L.table("documents").where(delivery), folder)
        taken.append(intake.ingest(L.spark, folder, corpus))
    taken.append(intake.ingest(L.spark, folder, corpus))
    return intake.documents(L.spark, corpus).select("id", "content", *(F.lit(n).alias(f"files_{i}") for i, n in enumerate(taken, 1)))


register(
    "ingest_documents",
    _ingested,
    # a text file ends with a line break
    """SELECT 'upload_' || sha256(content) AS id, content, files_1, files_2, 0 AS files_3 FROM (SELECT DISTINCT ifnull(text, '') || chr(10) AS content FROM documents),
      (SELECT count(*) FILTER (lang = 'en') AS files_1, count(*) FILTER (lang IS DISTINCT FROM 'en') AS files_2 FROM documents)""",
)
register(
    "documents_to_vectors",
    lambda L: retrieval.documents_to_vectors(L.table("documents").select(F.col("text").alias("content"), "source")),
    "SELECT 'upload_' || sha256(ifnull(text, '')) AS id, ifnull(text, '') AS content, min(ifnull(source, 'unknown')) AS source FROM documents GROUP BY ALL",
)
register(
    "corpus_status",
    lambda L: retrieval.corpus_status(L.table("documents"), "lang"),
    "SELECT lang, count(*) AS documents_count FROM documents GROUP BY ALL",
)


def _cleared(L: Layers) -> DataFrame:
    """The documents stored by namespace, after one namespace was emptied, read back from storage."""
    path = fresh_path(L.spark, "corpus")
    L.table("documents").write.partitionBy("lang").parquet(path)
    store.clear_partition(L.spark, path, "lang", "en")
    return L.spark.read.parquet(path)


register(
    "corpus_clear",
    lambda L: retrieval.corpus_status(_cleared(L), "lang"),
    "SELECT lang, count(*) AS documents_count FROM documents WHERE lang <> 'en' GROUP BY ALL",
)


def text_queries(L: Layers) -> DataFrame:
    asked = L.table("conversations").filter(F.col("role") == "user")
    return asked.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text")


def keyword_matches(L: Layers) -> DataFrame:
    return nearest.keyword_top_k(text_queries(L), L.table("documents").select(F.col("doc_id").alias("id"), "text"))


KEYWORD_SQL = r"""
SELECT query_id, id, score, row_number() OVER o AS rank FROM (
  SELECT a.query_id, a.doc_id AS id, round(ifnull(hits, 0) / greatest(1, size), 9) AS score
  FROM (SELECT query_id, size, doc_id FROM v_asked, documents) a
  LEFT JOIN (SELECT query_id, doc_id, count(*) AS hits FROM (SELECT query_id, unnest(tokens) AS token FROM v_asked) q
    JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM documents) d USING (token)
    GROUP BY ALL) m ON m.query_id = a.query_id AND m.doc_id = a.doc_id)
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, id) QUALIFY row_number() OVER o <= 5
"""
ASKED_SQL = r"""SELECT conv_id || ':' || turn AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tokens,
  len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS size FROM conversations WHERE role = 'user'"""


def _with_views(**views: str) -> None:
    from registry.sql import VIEWS

    VIEWS.update(views)


_with_views(v_asked=ASKED_SQL, v_keyword=KEYWORD_SQL)
register("keyword_topk", keyword_matches, "SELECT * FROM v_keyword")


def prototypes(L: Layers) -> DataFrame:
    """One query per label: the mean of its vectors, computed position by position."""
    cells = L.table("embeddings").select("label", F.posexplode("embedding").alias("at", "value"))
    means = cells.groupBy("label", "at").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "mean"))), lambda cell: cell["mean"])
    return means.groupBy("label").agg(ordered.alias("vector")).select(F.col("label").cast("string").alias("query_id"), "vector")


def vector_matches(L: Layers, k: int) -> DataFrame:
    corpus = L.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest.cosine_top_k(prototypes(L), corpus, k)


_with_views(
    v_prototypes="""SELECT label::VARCHAR AS query_id, list(mean ORDER BY place) AS vector FROM (
      SELECT label, place, avg(value) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS place FROM embeddings)
      GROUP BY ALL) GROUP BY ALL""",
    v_similar="""SELECT query_id, vec_id AS id, round(list_cosine_similarity(vector, embedding::DOUBLE[]), 9) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vector, embedding::DOUBLE[]), 9) DESC, vec_id) AS rank
    FROM v_prototypes, embeddings""",
)
register(
    "cosine_topk",
    lambda L: digits(vector_matches(L, 5), 6, "score"),
    "SELECT query_id, id, round(score, 6) AS score, rank FROM v_similar WHERE rank <= 5",
)


def vector_queries(L: Layers) -> DataFrame:
    """The stored vectors that are asked for: every fiftieth id, against all rows."""
    asked = L.table("embeddings").where(F.col("vec_id") % 50 == 0)
    return asked.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


def reranked(L: Layers) -> DataFrame:
    """The documents whose vectors are nearest to each query vector, by the rules for what an answer may use."""
    corpus = L.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    nearest_rows = nearest.cosine_top_k(vector_queries(L), corpus, 5 * retrieval.CANDIDATES_PER_RESULT).drop("rank")
    content = L.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    return retrieval.rerank(nearest_rows.join(content, "id"), 5)


_with_views(
    v_vectors_asked="SELECT vec_id::VARCHAR AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 50 = 0",
    v_near="""SELECT query_id, vec_id AS id, round(list_cosine_similarity(vector, embedding::DOUBLE[]), 9) AS score FROM v_vectors_asked, embeddings
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 15""",
    v_reranked=r"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT * FROM (SELECT c.query_id, c.id, c.score, d.source, regexp_replace(d.text, '^\s+|\s+$', '', 'g') AS content
        FROM v_near c JOIN documents d ON c.id = d.doc_id)
      WHERE score >= 0.65 AND content <> ''
      QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY score DESC, id) = 1)""",
    v_matches="SELECT * FROM v_reranked WHERE rank <= 5",
)
register(
    "rerank_filter",
    lambda L: digits(reranked(L), 6, "score").select("query_id", "id", "score", "source", "content", "rank"),
    "SELECT query_id, id, round(score, 6) AS score, source, content, rank FROM v_matches",
)
register(
    "source_label",
    lambda L: L.table("documents").select(
        "doc_id",
        retrieval.source_label(
            F.create_map(
                F.lit("source"),
                F.when(F.col("lang") == "en", F.col("source")),
                F.lit("filename"),
                F.when(F.col("lang") == "fr", F.lit("")),
                F.lit("order_id"),
                F.when(F.col("lang") == "de", F.col("doc_id").cast("string")),
            ),
            F.when(F.col("lang") != "es", F.concat(F.lit("doc-"), "doc_id")),
        ).alias("label"),
    ),
    """SELECT doc_id, CASE lang WHEN 'en' THEN source WHEN 'de' THEN 'Order ' || doc_id WHEN 'es' THEN 'Knowledge Base'
      ELSE 'doc-' || doc_id END AS label FROM documents""",
)
register(
    "retrieval_confidence",
    lambda L: retrieval.confidence(reranked(L), vector_queries(L)),
    """SELECT a.query_id, ifnull(round(least(1, greatest(0, avg(score)))::DECIMAL(18,9), 2)::DOUBLE, 0) AS confidence
      FROM v_vectors_asked a LEFT JOIN v_matches m USING (query_id) GROUP BY ALL""",
)
_with_views(
    v_sections="""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place,
      '[Record ' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || ' | Source: ' || source || ']' || chr(10) || content AS section,
      greatest(1000, 12000 // count(*) OVER (PARTITION BY query_id)) AS share FROM v_matches""",
    v_fold="""SELECT query_id, 0 AS place, 12000 AS room, NULL::VARCHAR AS context, NULL::VARCHAR AS piece FROM (SELECT DISTINCT query_id FROM v_sections)
      UNION ALL
      SELECT query_id, place, IF(room > 0, room - length(cut), room), IF(room > 0, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), context, cut), context), cut
      FROM (SELECT s.query_id, s.place, f.room, f.context,
          IF(length(s.section) > least(share, f.room),
            IF(instr(reverse(left(s.section, least(share, f.room))), ' ') > 0,
              left(s.section, least(share, f.room) - instr(reverse(left(s.section, least(share, f.room))), ' ')),
              left(s.section, least(share, f.room))) || '…', s.section) AS cut
        FROM v_fold f JOIN v_sections s ON s.query_id = f.query_id AND s.place = f.place + 1)""",
)
register(
    "context_pack",
    lambda L: retrieval.context_pack(reranked(L)),
    "SELECT query_id, context FROM v_fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place DESC) = 1",
)
register(
    "urgent_query_flag",
    lambda L: L.table("conversations").select("conv_id", "turn", retrieval.is_urgent(F.col("text")).alias("urgent")),
    """SELECT conv_id, turn, (len(list_filter([""" + ", ".join(f"'{t}'" for t in retrieval.URGENT_TERMS)
    + """], lambda term: contains(lower(text), term))) > 0)::INT AS urgent FROM conversations""",
)


def _records(L: Layers) -> DataFrame:
    return written(L.flat.drop(*gold.WINDOWED), "flat")


def _answer_sql(scope: str = "") -> str:
    records = f"(SELECT * FROM v_rows WHERE {scope})" if scope else "v_rows"
    rows = thousands(f"(SELECT count(*) FROM {records})")
    span = f"'the requested time period (' || {rows} || ' order rows)'" if scope else f"'all ' || {rows} || ' available order rows'"
    bulk = thousands(f"(SELECT count(*) FROM {records} WHERE quantity > 5 AND profit <= 0)")
    late = thousands(f"(SELECT count(*) FROM {records} WHERE is_late_delivery = 1)")
    line = lambda *parts: " || ".join(parts)
    reports = [
        ("Full-dataset product-sales calculation", f"'Exact product-sales ranking calculated from ' || {span} || ':'", RANK_PRODUCT,
         line("rank", "'. Product ID '", "product_id", "': total sales '", dollars("total_sales"), "'; total profit '", dollars("total_profit"), "'; '", thousands("orders"), "' orders.'")),
        ("Full-dataset department shipping-cost calculation", f"'Exact department shipping-cost ranking calculated from ' || {span} || ':'", RANK_DEPARTMENT.format(cost="cost"),
         line("rank", "'. '", "department", "': average shipping cost '", dollars("average_shipping_cost"), "' across '", thousands("orders"), "' orders.'")),
        ("Full-dataset sales and profit comparison", f"'Exact sales and profit comparison calculated from ' || {span} || ':'", f"SELECT *, year * 10 + quarter AS rank FROM ({BY_QUARTER})",
         line("'Year '", "year", "', Q'", "quarter", "': total sales '", dollars("total_sales"), "'; total profit '", dollars("total_profit"), "'; '", thousands("orders"), "' orders.'")),
        ("Full-dataset unprofitable bulk-order calculation", f"'Exact bulk-order profitability result from ' || {span} || ': ' || {bulk} || ' bulk orders are not profitable.' || chr(10) || 'The following are the 10 lowest-profit orders:'", BULK,
         line("'Order '", "order_id", "': product ID '", "product_id", "'; quantity '", "quantity", "'; sales '", dollars("sales"), "'; profit '", dollars("profit"), "'; profit margin '", fixed("(profit_margin * 100)", 2), "'%.'")),
        ("Full-dataset late-order calculation", f"'Exact late-order overview calculated from ' || {span} || ': ' || {late} || ' late orders.'", LATE_PAIRS,
         line("market", "' / '", "department", "': '", thousands("late_orders"), "' late orders; average lead time '", fixed("average_lead_time", 2), "' days.'")),
        ("Full-dataset shipping-mode lead-time calculation", f"'Exact shipping-mode lead-time comparison calculated from ' || {span} || ':'", MODE_LEAD,
         line("shipping_mode", "': average lead time '", fixed("average_lead_time", 2), "' days across '", thousands("orders"), "' orders.'")),
        ("Full-dataset lead-time calculation", f"'Exact longest-lead-time orders from ' || {span} || ':'", LONGEST,
         line("'Order '", "order_id", "': lead time '", "lead_time", "' days; product ID '", "product_id", "'; shipping mode '", "shipping_mode", "'.'")),
        ("Full-dataset quantity calculation", f"'Exact largest-quantity orders from ' || {span} || ':'", LARGEST,
         line("'Order '", "order_id", "': quantity '", "quantity", "'; sales '", dollars("sales"), "'; product ID '", "product_id", "'.'")),
    ]
    return " UNION ALL ".join(
        f"SELECT {heading} || chr(10) || string_agg({text}, chr(10) ORDER BY rank) AS content, '{source}' AS source, 1.0::DOUBLE AS similarity FROM ({body.replace('FROM v_rows', f'FROM {records}')})"
        for source, heading, body, text in reports
    )


register("exact_answer_docs", lambda L: answers.answer_documents(_records(L)), _answer_sql())


def _answers_of_a_quarter(L: Layers) -> DataFrame:
    records = _records(L)
    return answers.answer_documents(answers.in_scope(records, 1997, 2), records)


register("exact_answer_docs_scoped", _answers_of_a_quarter, _answer_sql("year(order_date) = 1997 AND quarter(order_date) = 2"))

# --- 2.12 streams ---------------------------------------------------------------------------------------------------


def order_stream(L: Layers) -> DataFrame:
    return order_events(live.read_events(L.spark, L.folder, "events.parquet"))


def ledger(L: Layers) -> DataFrame:
    return live.drain_to_files(live.score_orders(order_stream(L)), "ledger")


EVENT_SCORES = ["delivery_risk", "anomaly_risk", "supply_chain_risk", "risk_category"]
register(
    "stream_score_orders",
    lambda L: ledger(L).select("event_id", "shipment_status", *EVENT_SCORES),
    f"SELECT event_id, shipment_status, {', '.join(EVENT_SCORES)} FROM v_event_scores",
)


def _demand_points(L: Layers) -> DataFrame:
    """Monthly lag records written as files and read back as a stream."""
    path = fresh_path(L.spark, "lags")
    lags = demand.monthly_lags(L.sales).drop("rolling_mean_3").dropna(subset=["lag_3"])
    lags.repartition(4).write.parquet(path)
    arriving = L.spark.readStream.schema(lags.schema).parquet(path)
    return live.drain_to_files(live.demand_events(arriving), "demand")


register(
    "stream_demand_events",
    lambda L: _demand_points(L).select("month_start", "lag_1", "lag_2", "lag_3", "predicted_demand", "rolling_mean_3"),
    """SELECT month_start::VARCHAR AS month_start, lag_1, lag_2, lag_3, predicted_demand, round(mean3::DECIMAL(28,8), 2)::DOUBLE AS rolling_mean_3
      FROM v_forecasts WHERE predicted_demand IS NOT NULL""",
)
register(
    "stream_order_ledger",
    lambda L: tally(ledger(L), "shipping_mode", "shipment_status", "risk_category"),
    """SELECT shipping_mode, shipment_status, risk_category, count(*) AS "rows" FROM v_event_scores GROUP BY ALL""",
)
def newest(L: Layers) -> DataFrame:
    columns = ["ts", "event_id", "shipment_status", "supply_chain_risk"]
    return recent.newest_points(live.score_orders(order_stream(L)), "shipping_mode", columns)


register(
    "stream_last_n_by_mode",
    lambda L: recent.newest_per_key(newest(L)).select(F.col("key").alias("shipping_mode"), "position", "event_id", "supply_chain_risk"),
    """SELECT shipping_mode, row_number() OVER w AS position, event_id, supply_chain_risk FROM v_event_scores
      WINDOW w AS (PARTITION BY shipping_mode ORDER BY ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 30""",
)
register(
    "stream_last_n",
    lambda L: live.last_points(newest(L)).select("event_id", "shipment_status", "supply_chain_risk"),
    "SELECT event_id, shipment_status, supply_chain_risk FROM v_event_scores ORDER BY ts DESC, event_id DESC LIMIT 30",
)
register(
    "live_status_counts",
    lambda L: live.drain_latest(live.status_counts(order_stream(L)), "status"),
    "SELECT shipment_status, count(*) AS orders FROM v_events GROUP BY ALL",
)
register("live_shipment_counts", lambda L: shipments.live_counts(ledger(L)), "SELECT * FROM v_live")
MODE_RATES = """SELECT mode, orders, late, late / orders * 100 AS late_pct FROM (SELECT shipping_mode AS mode, count(*) AS orders,
  count(*) FILTER (shipment_status IN ('Delayed', 'At Risk')) AS late FROM v_events GROUP BY ALL) ORDER BY late_pct DESC, mode LIMIT 4"""
register(
    "live_mode_late_rate",
    lambda L: live.worst_modes(live.drain_latest(live.mode_late_rate(order_stream(L)), "modes")),
    MODE_RATES,
)
register(
    "live_summary",
    lambda L: live.live_summary(ledger(L)),
    """SELECT count(*) AS total, avg((shipment_status = 'Delivered')::INT) * 100 AS on_time_pct,
      avg((shipment_status IN ('Delayed', 'At Risk'))::INT) * 100 AS late_pct, count(*) FILTER (shipment_status = 'Returned') AS returned FROM v_events""",
)
register(
    "live_shipment_records",
    lambda L: shipments.live_records(ledger(L)).drop("ts"),
    f"SELECT * EXCLUDE (part, sort_ts) FROM ({LIVE_ROWS})",
)


def _last_demand(L: Layers) -> DataFrame:
    points = _demand_points(L).withColumn("period", F.date_format("month_start", "MMM yyyy"))
    return points.orderBy(F.col("month_start").desc()).limit(live.POINTS_SHOWN)


register(
    "live_demand_series",
    lambda L: live.live_demand_series(_last_demand(L)),
    """SELECT period, a::DOUBLE AS actual, f::DOUBLE AS forecast, (f + band)::DOUBLE AS upper, greatest(0, f - band)::DOUBLE AS lower FROM (
      SELECT *, greatest(abs(a - f), round_even(abs(f) * 0.08, 0)) AS band FROM (
        SELECT strftime(month_start, '%b %Y') AS period, round_even(round(mean3::DECIMAL(28,8), 2)::DOUBLE, 0)::DECIMAL(18,2) AS a,
          round_even(predicted_demand, 0)::DECIMAL(18,2) AS f FROM v_forecasts WHERE predicted_demand IS NOT NULL
        ORDER BY month_start DESC LIMIT 10))""",
)
register(
    "live_accuracy",
    lambda L: digits(live.live_accuracy(_last_demand(L)), 6, "accuracy"),
    """SELECT round(least(100, greatest(0, 100 - sum(abs(predicted_demand - m)) / CASE WHEN sum(m) = 0 THEN 1 ELSE sum(m) END * 100)), 6) AS accuracy FROM (
      SELECT predicted_demand, round(mean3::DECIMAL(28,8), 2)::DOUBLE AS m FROM v_forecasts WHERE predicted_demand IS NOT NULL
      ORDER BY month_start DESC LIMIT 10)""",
)


def _refreshed(L: Layers) -> DataFrame:
    query, store = marts.refresh_marts(live.score_orders(order_stream(L)), marts.order_states(), "marts", once=True)
    query.awaitTermination()
    return marts.payloads(store)


_with_views(
    v_days="""SELECT day, value, avg(value) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS forecast
      FROM (SELECT ts::DATE AS day, sum(sales::DECIMAL(38,2)) AS value FROM v_event_scores GROUP BY ALL) ORDER BY day DESC LIMIT 10""",
    v_newest="SELECT * FROM v_event_scores ORDER BY ts DESC, event_id DESC LIMIT 20",
)
register(
    "stream_refresh_marts",
    _refreshed,
    f"""SELECT 'dashboard' AS part, 'orders' AS entry, count(*)::DOUBLE AS value FROM v_events
      UNION ALL SELECT 'dashboard', 'on_time_pct', round(count(*) FILTER (shipment_status = 'Delivered') * 100.0 / count(*), 6)::DOUBLE FROM v_events
      UNION ALL SELECT 'dashboard', 'late_pct', round(count(*) FILTER (shipment_status IN ('Delayed', 'At Risk')) * 100.0 / count(*), 6)::DOUBLE FROM v_events
      UNION ALL SELECT 'dashboard', 'returned', (count(*) FILTER (shipment_status = 'Returned'))::DOUBLE FROM v_events
      UNION ALL SELECT * FROM (SELECT 'activity', event_id || ' ' || shipment_status, supply_chain_risk FROM v_newest ORDER BY ts DESC, event_id DESC LIMIT 5)
      UNION ALL SELECT 'inventory', shipment_status, sum(sales::DECIMAL(38,2))::DOUBLE FROM v_events GROUP BY ALL
      UNION ALL SELECT 'forecasting', 'actual ' || day, round(value::DOUBLE, 2) FROM v_days
      UNION ALL SELECT 'forecasting', 'forecast ' || day, round(forecast::DOUBLE, 2) FROM v_days
      UNION ALL SELECT 'shipments', concat_ws(' ', id, carrier, status, progress), risk_score::DOUBLE FROM ({LIVE_ROWS} QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 20)
      UNION ALL SELECT 'risk', shipping_mode || ' / ' || risk_category, round(sum(supply_chain_risk::DECIMAL(38,2))::DOUBLE / count(*), 4) FROM v_event_scores GROUP BY shipping_mode, risk_category""",
)
register(
    "stream_tumbling_status",
    lambda L: live.drain_to_files(live.tumbling_status(order_stream(L)), "hours"),
    # windows that the watermark, ten minutes behind the newest event, has closed
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, shipment_status, count(*) AS orders FROM v_events
      WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM v_events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)


def _replayed(L: Layers) -> DataFrame:
    """Every event arrives twice."""
    path, events = fresh_path(L.spark, "replayed"), L.table("events")
    for _ in range(2):
        events.write.mode("append").parquet(path)
    return order_events(live.read_events(L.spark, path))


register(
    "stream_dedup_orders",
    lambda L: tally(live.drain_to_files(live.without_replays(_replayed(L)), "unique"), "shipment_status"),
    """SELECT shipment_status, count(DISTINCT event_id) AS "rows" FROM v_events GROUP BY ALL""",
)
register(
    "dashboard_summary",
    _dashboard,
    f"""SELECT 'kpi_metrics' AS part, id, label || '|' || hint AS texts, value FROM ({KPI})
      UNION ALL SELECT 'activity_feed', id, agent || '|' || action || '|' || status, NULL FROM ({FEED})
      UNION ALL SELECT 'insights', id, title || '|' || summary || '|' || impact || '|' || confidence || '|' || category, round(value, 6) FROM ({INSIGHTS})
      UNION ALL SELECT 'replenishment', id, title || '|' || description || '|' || status, NULL FROM ({REPLENISH})
      UNION ALL SELECT 'utilisation', id, name || '|' || utilisation || '|' || capacity, NULL FROM ({UTILISATION})
      UNION ALL SELECT 'shipment_stats', NULL, total || '|' || on_time || '|' || delayed || '|' || at_risk, NULL FROM ({STATS})""",
)
