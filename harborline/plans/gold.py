"""Gold layer: joined and feature tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions.bands import below_reorder
from harborline.functions.measures import mean, non_zero, zero_if_null
from harborline.operators.joins import with_stock, with_stock_by_text, with_supplier_statistics
from harborline.operators.rolling import ExactMean, RowCount, rolling

# Frame length in rows and the flag thresholds.
FRAME_ROWS = 30
HIGH_VALUE_ABOVE, BULK_ABOVE = 300, 5

STOCK = ["lead_time", "current_stock", "reorder_point", "avg_order", "safety_stock"]
SUPPLIER = [
    "avg_defect_rate",
    "max_defect_rate",
    "avg_shipping_cost",
    "avg_shipping_time",
    "sc_avg_lead_time",
    "avg_stock_level",
    "num_skus",
    "num_suppliers",
]
SALES = [
    "order_id",
    "order_date",
    "shipment_date",
    "product_id",
    "customer_id",
    "customer_segment",
    "sales",
    "quantity",
    "profit",
    "is_late_delivery",
    "shipping_mode",
    "market",
    "department",
    "class",
]
MISSING_FLAGS = {
    "lead_time_missing": "lead_time",
    "stock_missing": "current_stock",
    "defect_missing": "avg_defect_rate",
    "shipping_cost_missing": "avg_shipping_cost",
}


def _calendar(day: str) -> dict:
    return {
        "day_of_week": F.dayofweek(day),
        "month": F.month(day),
        "quarter": F.quarter(day),
        "year": F.year(day),
    }


def supplier_statistics(supply: DataFrame) -> DataFrame:
    """Quality, cost and stock measures per product type; distinct counts are exact."""
    return supply.groupBy("product_type").agg(
        mean(F.col("defect_rates")).alias("avg_defect_rate"),
        F.max("defect_rates").cast("double").alias("max_defect_rate"),
        mean(F.col("shipping_costs")).alias("avg_shipping_cost"),
        mean(F.col("shipping_times")).alias("avg_shipping_time"),
        mean(F.col("lead_times")).alias("sc_avg_lead_time"),
        mean(F.col("stock_levels")).alias("avg_stock_level"),
        F.countDistinct("sku").alias("num_skus"),
        F.countDistinct("supplier_name").alias("num_suppliers"),
    )


def joined_sales(sales: DataFrame, inventory: DataFrame, supply: DataFrame, gather: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sales with stock and supplier columns, zeros for what is missing, and flags that say what was missing.

    ``product_type`` is kept: it tells the copies of a fanned-out row apart. ``gather`` deals rows to tasks before the supplier
    statistics, which are always broadcast, multiply and widen them.
    """
    stocked = with_stock(sales, inventory)
    joined = with_supplier_statistics(stocked if gather is None else gather(stocked), supplier_statistics(supply))
    flags = [F.col(name).isNull().cast("int").alias(flag) for flag, name in MISSING_FLAGS.items()]
    filled = [zero_if_null(F.col(name)).alias(name) for name in (*STOCK, *SUPPLIER)]
    return joined.select(*SALES, *filled, *flags, "product_type")


def sales_ml_clean(sales: DataFrame, inventory: DataFrame, supply: DataFrame) -> DataFrame:
    return joined_sales(sales, inventory, supply).drop("product_type")


def inventory_ml_clean(retail: DataFrame, inventory: DataFrame) -> DataFrame:
    joined = with_stock_by_text(retail, inventory)
    return joined.select(
        "date",
        "store_id",
        "product_id",
        F.col("sales").alias("store_sales"),
        F.col("stock").alias("store_stock"),
        *(zero_if_null(F.col(name)).alias(name) for name in STOCK),
        F.col("lead_time").isNull().cast("int").alias("lead_time_missing"),
        F.col("current_stock").isNull().cast("int").alias("stock_missing"),
    )


def rolling_store_product(df: DataFrame) -> DataFrame:
    """Sum, mean and standard deviation of the last 30 days on record per store and product.

    After deduplication a (store, product) pair has at most one row per day, so no pair can grow large.
    """
    deviation = F.stddev_samp(F.col("store_sales").cast("double"))
    return rolling(
        df,
        ["store_id", "product_id"],
        ["date"],
        FRAME_ROWS,
        {
            "sales_30d": lambda w: zero_if_null(F.sum("store_sales").over(w).cast("double")),
            "avg_sales_30d": lambda w: zero_if_null(mean(F.col("store_sales"), w)),
            "stddev_sales_30d": lambda w: zero_if_null(deviation.over(w)),
        },
        ["store_sales"],
    )


def inventory_features(inventory_ml: DataFrame, as_of: dt.date) -> DataFrame:
    rows = rolling_store_product(inventory_ml.filter(F.col("date").isNotNull() & F.col("store_sales").isNotNull()))
    cover = F.round(F.col("current_stock") / non_zero(F.col("avg_order")), 2)
    return rows.select(
        "date",
        "store_id",
        "product_id",
        "store_sales",
        "current_stock",
        "reorder_point",
        "sales_30d",
        "avg_sales_30d",
        "stddev_sales_30d",
        zero_if_null(cover).alias("days_inventory_outstanding"),
        below_reorder(F.col("current_stock"), F.col("reorder_point")).alias("stock_below_reorder"),
        *(value.alias(name) for name, value in _calendar("date").items()),
        F.lit(as_of).cast("timestamp").alias("created_at"),
        F.lit(as_of).alias("feature_date"),
    )


def _order(df: DataFrame) -> list[str]:
    ties = [name for name in ("product_type",) if name in df.columns]
    return ["order_date", "order_id", "product_id", *ties]


def _moving_mean(df: DataFrame, name: str):
    """Doubles are added frame by frame, since differences of their running sums would not be exact."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return lambda w: mean(F.col(name), w)
    return ExactMean(name)


def rolling_customer(df: DataFrame, heavy: DataFrame | None = None, slices: DataFrame | None = None) -> DataFrame:
    """Mean order value and row count of a customer's last 30 rows; heavy customers are cut into blocks."""
    return rolling(
        df,
        ["customer_id"],
        _order(df),
        FRAME_ROWS,
        {
            "avg_order_value_30d": _moving_mean(df, "sales"),
            "num_orders_30d": RowCount(),
        },
        ["sales"],
        heavy,
        slices,
    )


def rolling_mode(
    df: DataFrame,
    slices: DataFrame | None = None,
    copies_from: DataFrame | None = None,
    gather: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Mean lead time and late share of a shipping mode's last 30 rows; the few modes are always cut into blocks."""
    return rolling(
        df,
        ["shipping_mode"],
        _order(df),
        FRAME_ROWS,
        {
            "avg_lead_time_by_mode": _moving_mean(df, "lead_time"),
            "late_delivery_rate_by_mode": _moving_mean(df, "is_late_delivery"),
        },
        ["lead_time", "is_late_delivery"],
        "all",
        slices,
        copies_from,
        gather,
    )


def delivery_rows(
    joined: DataFrame,
    as_of: dt.date,
    heavy_customers: DataFrame | None = None,
    slices: DataFrame | None = None,
    high_value_above: float = HIGH_VALUE_ABOVE,
    bulk_above: int = BULK_ABOVE,
    gather: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Every joined column plus the delivery features, in one pass; ``gather`` deals rows to the blocks of the shipping modes.

    Both feature tables are selections of this frame, never joins back to it: after the fan-out
    (order_id, product_id) is not a key.
    """
    orders = joined.filter(F.col("order_id").isNotNull())
    rows = rolling_mode(rolling_customer(orders, heavy_customers, slices), slices, orders, gather)
    profit, sales = F.col("profit").cast("double"), F.col("sales").cast("double")
    return rows.withColumns(
        {
            "order_processing_days": F.datediff("shipment_date", "order_date"),
            "days_since_shipment": F.datediff(F.lit(as_of), "shipment_date"),
            "is_high_value": (F.col("sales") > high_value_above).cast("int"),
            "is_bulk_order": (F.col("quantity") > bulk_above).cast("int"),
            "is_profitable": (F.col("profit") > 0).cast("int"),
            "profit_margin": F.round(profit / non_zero(sales), 3),
            **_calendar("order_date"),
            "created_at": F.lit(as_of).cast("timestamp"),
            "feature_date": F.lit(as_of),
        }
    )


DELIVERY = [
    *SALES[:12],
    "lead_time",
    "order_processing_days",
    "days_since_shipment",
    "avg_order_value_30d",
    "num_orders_30d",
    "avg_lead_time_by_mode",
    "late_delivery_rate_by_mode",
    "is_high_value",
    "is_bulk_order",
    "is_profitable",
    "profit_margin",
    "day_of_week",
    "month",
    "quarter",
    "year",
    "created_at",
    "feature_date",
]

# What the moving windows add; readers that need none of it drop these, and no window is computed.
WINDOWED = ["avg_order_value_30d", "num_orders_30d", "avg_lead_time_by_mode", "late_delivery_rate_by_mode"]

# The fields of the flat order record, in the order its text form lists them.
FLAT_RECORD = [
    "order_id",
    "product_id",
    "customer_id",
    "customer_segment",
    "sales",
    "quantity",
    "profit",
    "profit_margin",
    "shipping_mode",
    "lead_time",
    "order_processing_days",
    "market",
    "department",
    "class",
    "is_late_delivery",
    "is_high_value",
    "is_bulk_order",
    "is_profitable",
    "day_of_week",
    "month",
    "quarter",
    "year",
    "order_date",
    "shipment_date",
    "avg_order_value_30d",
    "num_orders_30d",
    "avg_lead_time_by_mode",
    "late_delivery_rate_by_mode",
    "avg_shipping_cost",
    "avg_defect_rate",
    "max_defect_rate",
    "feature_extraction_date",
]
COMBINED = [
    "is_late_delivery",
    "order_id",
    "product_id",
    "customer_id",
    "customer_segment",
    "sales",
    "quantity",
    "profit",
    "shipping_mode",
    "market",
    "lead_time",
    "order_processing_days",
    "avg_order_value_30d",
    "num_orders_30d",
    "avg_lead_time_by_mode",
    "late_delivery_rate_by_mode",
    "is_high_value",
    "is_bulk_order",
    "is_profitable",
    "profit_margin",
    "day_of_week",
    "month",
    "quarter",
    "year",
]


def delivery_features(rows: DataFrame) -> DataFrame:
    return rows.select(*DELIVERY)


def combined_features(delivery: DataFrame, as_of: dt.date) -> DataFrame:
    """Model columns of the features extracted on the given day."""
    fresh = delivery.filter(F.col("feature_date") == F.lit(as_of))
    return fresh.select(*COMBINED, F.lit(as_of).alias("feature_extraction_date"))


def flat_order_record(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("feature_date", "feature_extraction_date").select(*FLAT_RECORD)


def integrated(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Order rows (dated by order_date) and store rows (dated by date) in one history table.

    No build step for this table is published; its columns are inferred from the reports that read it.
    """
    orders = rows.select(
        "order_id",
        "order_date",
        "shipment_date",
        "product_id",
        "shipping_mode",
        "sales",
        "quantity",
        "profit",
        "is_late_delivery",
        "lead_time",
        "avg_lead_time_by_mode",
        "avg_order_value_30d",
        "avg_shipping_cost",
    ).withColumn("product_id", F.col("product_id").cast("string"))
    stores = inventory.select("date", "product_id", F.col("store_sales").cast("decimal(18,2)").alias("units_sold"))
    return orders.unionByName(stores, allowMissingColumns=True)
