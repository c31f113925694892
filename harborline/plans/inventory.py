"""Current stock per product and store, and status history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import bands, display
from harborline.functions.measures import count_where
from harborline.operators.keep import keep_first, latest, ranked_top

STATUSES = ("Healthy", "Low", "Critical", "Overstock")


def status_history(inventory: DataFrame, months: int = 7) -> DataFrame:
    """Rows per stock status and month, latest months, oldest first."""
    status = bands.stock_status(F.col("current_stock"), F.col("reorder_point"))
    monthly = (
        inventory.filter(F.col("date").isNotNull())
        .withColumn("status", status)
        .groupBy(F.trunc("date", "month").alias("month_start"))
        .agg(*(count_where(F.col("status") == name).alias(name.lower()) for name in STATUSES))
    )
    return latest(monthly, "month_start", months).withColumn("month", F.date_format("month_start", "MMM"))


def latest_inventory(inventory: DataFrame) -> DataFrame:
    """The latest row per product and store."""
    columns = ["product_id", "store_id", "date", "current_stock", "reorder_point", "days_inventory_outstanding"]
    return keep_first(inventory.select(*columns), ["product_id", "store_id"], [F.col("date").desc_nulls_last()])


def product_meta(sales: DataFrame) -> DataFrame:
    """Category per product: a department, else a class, else General."""
    return sales.groupBy("product_id").agg(
        F.coalesce(F.max("department"), F.max("class"), F.lit("General")).alias("category")
    )


def with_category(stock: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join on the textual product id; the category side is aggregated to one row per product first."""
    names = meta.select(F.col("product_id").cast("string").alias("product_id"), "category")
    return stock.withColumn("product_id", F.col("product_id").cast("string")).join(names, "product_id", "left")


def items(inventory: DataFrame, sales: DataFrame, n: int = 200) -> DataFrame:
    """Stock list: rows below their reorder point first, then by stock."""
    rows = with_category(latest_inventory(inventory), product_meta(sales))
    stock, point = F.col("current_stock"), F.col("reorder_point")
    short_first = F.when((point > 0) & (stock < point), 0).otherwise(1)
    order = [short_first, stock, F.col("product_id"), F.col("store_id")]
    return ranked_top(rows, order, n, "position").select(
        "position",
        F.col("product_id").alias("sku"),
        F.coalesce("category", F.lit("General")).alias("category"),
        F.col("store_id").cast("string").alias("warehouse"),
        F.col("current_stock").cast("bigint").alias("stock"),
        F.col("reorder_point").cast("bigint").alias("reorder_point"),
        bands.stock_status(stock, point).alias("status"),
        display.whole(F.col("days_inventory_outstanding")).alias("days_of_cover"),
    )


def critical_sku_count(inventory: DataFrame) -> DataFrame:
    """Critical rows of the whole current stock, not only of the list on show."""
    status = bands.stock_status(F.col("current_stock"), F.col("reorder_point"))
    return latest_inventory(inventory).agg(count_where(status == "Critical").alias("critical_skus"))
