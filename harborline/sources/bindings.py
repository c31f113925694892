"""Benchmark tables (orders, lineitem, part, ...) in the shapes of the supply-chain schemas.

``raw_*`` frames are string-typed like the source CSV files and contain the dirty values the silver layer must
handle; the others are already clean. Everything is derived from whole tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(1998, 9, 2)
MONEY = "decimal(18,2)"
# The one brand that is shipped by its maker and therefore has no stock record.
DROP_SHIPPED_BRAND = "Brand#9"


# Column types of the benchmark tables; with them a read needs no job to look at file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def bought_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with its order, customer and region."""
    place = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    buyers = table(spark, folder, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, folder, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with its order, customer, region and part."""
    return bought_lines(spark, folder).join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))


def _price():
    return F.col("l_extendedprice").cast(MONEY)


def _profit():
    margin = F.lit("0.06").cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    return (_price() * margin).cast("decimal(18,4)")


def _department():
    return F.when(F.col("p_type") == "PROMO", "Health and Beauty").otherwise(F.col("p_type"))


def sales(spark: SparkSession, folder: str, gather: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """Clean order rows before deduplication; ``gather`` deals them to tasks by product, in place of a shuffle, before parts are joined."""
    sold = bought_lines(spark, folder).select(
        F.col("l_orderkey").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.to_date("l_shipdate").alias("shipment_date"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("customer_segment"),
        _price().alias("sales"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _profit().alias("profit"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_late_delivery"),
        F.col("o_orderpriority").alias("shipping_mode"),
        F.col("r_name").alias("market"),
    )
    if gather is not None:
        sold = gather(sold, ["product_id"])
    parts = table(spark, folder, "part").select("p_partkey", _department().alias("department"), F.col("p_brand").alias("class"))
    return sold.join(parts, F.col("product_id") == F.col("p_partkey")).drop("p_partkey")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Stock record per product; drop-shipped products have none, which drives the missing flags."""
    size = F.col("p_size")
    return (
        table(spark, folder, "part")
        .filter(F.col("p_brand") != DROP_SHIPPED_BRAND)
        .select(
            F.col("p_partkey").alias("product_id"),
            size.alias("lead_time"),
            F.pmod(F.col("p_partkey") * 37, F.lit(400)).cast("int").alias("current_stock"),
            (size * 4).alias("reorder_point"),
            F.pmod(F.col("p_partkey"), F.lit(7)).cast("int").alias("avg_order"),
            (size * 2).alias("safety_stock"),
        )
    )


def supply(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier deliveries per product before deduplication."""
    lines = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    kind = (
        F.when(F.col("p_type") == "STANDARD", "haircare")
        .when(F.col("p_type") == "ECONOMY", "skincare")
        .when(F.col("p_type") == "PROMO", "cosmetics")
        .otherwise("other")
    )
    return lines.select(
        F.col("l_partkey").alias("sku"),
        kind.alias("product_type"),
        _price().alias("revenue"),
        F.col("l_quantity").cast("int").alias("stock_levels"),
        F.col("p_size").alias("lead_times"),
        F.col("l_linenumber").cast("int").alias("shipping_times"),
        (F.col("l_tax").cast("decimal(4,2)") * 100).cast("decimal(10,2)").alias("shipping_costs"),
        F.col("s_name").alias("supplier_name"),
        (F.col("l_discount").cast("decimal(4,2)") * 50).cast("decimal(10,2)").alias("defect_rates"),
    )


def retail(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sales per store (supplier nation) and article (part size), so the 30-row frames fill."""
    lines = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return lines.groupBy(
        F.to_date("l_shipdate").alias("date"), F.col("s_nationkey").alias("store_id"), F.col("p_size").alias("product_id")
    ).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast(MONEY).alias("sales"),
        F.max("l_quantity").cast("int").alias("stock"),
    )


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales file: three date layouts, '-' for unshipped rows, missing customers, unreadable amounts."""
    ordered, shipped = F.col("o_orderdate"), F.col("l_shipdate")
    priority = F.col("o_orderpriority")
    order_text = (
        F.when(priority.isin("1-URGENT", "2-HIGH"), F.date_format(ordered, "M/d/yyyy H:mm"))
        .when(priority == "3-MEDIUM", F.date_format(ordered, "yyyy-MM-dd HH:mm:ss"))
        .when(priority == "4-NOT SPECIFIED", F.date_format(ordered, "yyyy-MM-dd"))
        .when(F.col("l_tax") == 0, F.lit("n/a"))
        .otherwise(F.date_format(ordered, "M/d/yyyy H:mm"))
    )
    ship_text = (
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), F.lit("-"))
        .when(F.col("l_linestatus") == "O", F.date_format(shipped, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(shipped, "M/d/yyyy H:mm"))
    )
    no_segment = F.col("c_mktsegment") == "MACHINERY"
    return order_lines(spark, folder).select(
        F.when(F.col("l_linenumber") < 7, F.col("l_orderkey").cast("string")).alias("Order Id"),
        order_text.alias("order date (DateOrders)"),
        ship_text.alias("shipping date (DateOrders)"),
        F.col("l_partkey").cast("string").alias("Product Id"),
        F.when(~no_segment, F.col("o_custkey").cast("string")).alias("Customer Id"),
        F.when(~no_segment, F.col("c_mktsegment")).alias("Customer Segment"),
        F.when(F.col("l_discount") == 0, "abc").otherwise(_price().cast("string")).alias("Sales"),
        F.when(F.col("l_quantity") == 50, "12.5")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("Order Item Quantity"),
        _profit().cast("string").alias("Order Profit Per Order"),
        F.when(F.col("l_returnflag") == "R", " Late Delivery ")
        .when(F.col("l_returnflag") == "A", "Shipping on time")
        .alias("Delivery Status"),
        F.when(priority != "4-NOT SPECIFIED", priority).alias("Shipping Mode"),
        F.col("r_name").alias("Market"),
        _department().alias("Department Name"),
        F.col("p_brand").alias("Class"),
    )


def raw_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Stock file with a second, older count per product and unreadable sizes for one brand."""
    counts = F.explode(
        F.array(F.pmod(F.col("p_partkey") * 37, F.lit(400)), F.pmod(F.col("p_partkey") * 11, F.lit(400)))
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", counts.alias("on_hand"))
    size = F.when(F.col("p_brand") != "Brand#1", F.col("p_size"))
    return parts.select(
        F.when(F.col("p_brand") != "Brand#2", F.col("p_partkey").cast("string")).alias("product id"),
        F.coalesce(size.cast("string"), F.lit("?")).alias("avg lead time"),
        F.col("on_hand").cast("string").alias("current stock"),
        (size * 4).cast("string").alias("reorder point"),
        F.pmod(F.col("p_partkey"), F.lit(7)).cast("string").alias("avg order qty"),
        (F.col("p_size") * 2).cast("string").alias("safety stock"),
    )


def raw_supply(spark: SparkSession, folder: str) -> DataFrame:
    lines = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    whole = lambda name: F.col(name).cast("int").cast("string")
    return lines.select(
        F.col("p_type").alias("Product type"),
        F.concat(F.lit("SKU"), F.col("l_partkey")).alias("SKU"),
        F.col("p_retailprice").cast(MONEY).cast("string").alias("Price"),
        whole("l_linenumber").alias("Availability"),
        whole("l_quantity").alias("Number of products sold"),
        F.when(F.col("l_discount") == 0, "-").otherwise(_price().cast("string")).alias("Revenue generated"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("Customer demographics"),
        whole("l_quantity").alias("Stock levels"),
        whole("p_size").alias("Lead times"),
        whole("l_quantity").alias("Order quantities"),
        whole("l_linenumber").alias("Shipping times"),
        F.when(F.col("l_linestatus") == "F", "Carrier F").alias("Shipping carriers"),
        F.col("l_tax").cast("decimal(4,2)").cast("string").alias("Shipping costs"),
        F.col("s_name").alias("Supplier name"),
        F.col("n_name").alias("Location"),
        F.col("l_discount").cast("decimal(4,2)").cast("string").alias("Defect rates"),
    )


def raw_retail(spark: SparkSession, folder: str) -> DataFrame:
    """Store file: every order line as its own row, so (store, product, day) repeats."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    day = (
        F.when(F.col("l_returnflag") == "N", F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(F.col("l_returnflag") == "A", F.date_format("l_shipdate", "M/d/yyyy H:mm"))
        .when(F.col("l_tax") == 0, F.lit("-"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    )
    return lines.select(
        day.alias("Date"),
        F.concat(F.lit("S"), F.col("s_nationkey")).alias("Store ID"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("Product ID"),
        F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("Units Sold"),
        F.col("l_linenumber").cast("string").alias("Inventory Level"),
    )


def raw_warehouses(spark: SparkSession, folder: str, measure: str) -> DataFrame:
    """Warehouse file with the given measure column; each site is listed for every part line it delivered."""
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    sites = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return sites.select(
        F.when(F.col("r_name") != "ASIA", F.concat(F.lit("W"), F.col("s_suppkey"))).alias("warehouse_id"),
        F.when(F.col("r_name") != "EUROPE", F.col("r_name")).alias("region_type"),
        F.when(F.col("s_acctbal") > 5000, "1").when(F.col("s_acctbal") > 1000, "0").otherwise("no").alias("has_wms"),
        F.when(F.col("l_returnflag") == "N", "n/a")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias(measure),
    )


# How the benchmark's event types stand for shipment states.
STATUS_OF_EVENT = {"purchase": "Delivered", "view": "In Transit", "error": "Delayed", "click": "At Risk"}


def order_events(events: DataFrame) -> DataFrame:
    """Order events (batch or stream): the JSON reading k supplies lead time and shipping mode."""
    reading = F.get_json_object("props", "$.k").cast("int")
    state = F.lit("Returned")
    for event_type, name in STATUS_OF_EVENT.items():
        state = F.when(F.col("event_type") == event_type, name).otherwise(state)
    mode = (
        F.when(reading < 25, "Same Day")
        .when(reading < 50, "First Class")
        .when(reading < 75, "Second Class")
        .otherwise("Standard Class")
    )
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("customer_id"),
        F.col("value").cast(MONEY).alias("sales"),
        state.alias("shipment_status"),
        mode.alias("shipping_mode"),
        (reading / 10).alias("lead_time"),
        F.lit(5.0).alias("avg_lead_time_by_mode"),
        (F.pmod("user_id", F.lit(7)) * 1.0).alias("avg_defect_rate"),
    )
