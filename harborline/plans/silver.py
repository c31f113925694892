"""Silver layer: typed, defaulted and deduplicated tables from string-typed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions.cleaning import (
    customer_or_none,
    late_flag,
    number_or_zero,
    parse_date,
    text_or_unknown,
)
from harborline.operators.keep import keep_first, keep_greatest


def _raw(name: str):
    return F.col(f"`{name}`")


def cleaned_sales(raw: DataFrame) -> DataFrame:
    """Typed sales rows with both keys; dates may still be NULL."""
    return raw.dropna(subset=["Order Id", "Product Id"]).select(
        _raw("Order Id").try_cast("bigint").alias("order_id"),
        parse_date(_raw("order date (DateOrders)")).alias("order_date"),
        parse_date(_raw("shipping date (DateOrders)")).alias("shipment_date"),
        _raw("Product Id").try_cast("bigint").alias("product_id"),
        customer_or_none(_raw("Customer Id")).alias("customer_id"),
        text_or_unknown(_raw("Customer Segment")).alias("customer_segment"),
        number_or_zero(_raw("Sales"), "double").alias("sales"),
        number_or_zero(_raw("Order Item Quantity"), "int").alias("quantity"),
        number_or_zero(_raw("Order Profit Per Order"), "double").alias("profit"),
        late_flag(_raw("Delivery Status")).alias("is_late_delivery"),
        text_or_unknown(_raw("Shipping Mode")).alias("shipping_mode"),
        text_or_unknown(_raw("Market")).alias("market"),
        text_or_unknown(_raw("Department Name")).alias("department"),
        text_or_unknown(_raw("Class")).alias("class"),
    )


def _dated():
    return F.col("order_date").isNotNull() & F.col("shipment_date").isNotNull()


def sales(raw: DataFrame, counted: bool = False) -> DataFrame:
    return dedup_sales(cleaned_sales(raw).filter(_dated()), counted)


def sales_rejects(raw: DataFrame) -> DataFrame:
    """Rows whose order or shipment date is missing or unreadable; not deduplicated."""
    return cleaned_sales(raw).filter(~_dated())


def inventory_stock(raw: DataFrame, counted: bool = False) -> DataFrame:
    number = lambda name: number_or_zero(_raw(name), "int")
    typed = raw.dropna(subset=["product id"]).select(
        _raw("product id").try_cast("bigint").alias("product_id"),
        number("avg lead time").alias("lead_time"),
        number("current stock").alias("current_stock"),
        number("reorder point").alias("reorder_point"),
        number("avg order qty").alias("avg_order"),
        number("safety stock").alias("safety_stock"),
    )
    return dedup_inventory(typed, counted)


def _warehouse(raw: DataFrame, measure: str, type_name: str, name: str) -> DataFrame:
    typed = raw.dropna(subset=["warehouse_id"]).select(
        "warehouse_id",
        text_or_unknown(_raw("region_type")).alias("region_type"),
        number_or_zero(_raw("has_wms"), "int").alias("has_wms"),
        number_or_zero(_raw(measure), type_name).alias(name),
    )
    return dedup_warehouse(typed, name)


def regional_warehouse(raw: DataFrame) -> DataFrame:
    return _warehouse(raw, "capacity_utilisation_pct", "double", "capacity_utilisation_pct")


def district_store(raw: DataFrame) -> DataFrame:
    return _warehouse(raw, "warehouse_size_sqm", "int", "capacity")


def national_store(raw: DataFrame) -> DataFrame:
    return _warehouse(raw, "warehouse_size_sqm", "int", "capacity")


def supply_chain(raw: DataFrame, counted: bool = False) -> DataFrame:
    whole = lambda name: number_or_zero(_raw(name), "int")
    money = lambda name: number_or_zero(_raw(name), "double")
    typed = raw.dropna(subset=["SKU"]).select(
        _raw("SKU").alias("sku"),
        _raw("Product type").alias("product_type"),
        money("Price").alias("price"),
        whole("Availability").alias("availability"),
        whole("Number of products sold").alias("number_of_products_sold"),
        money("Revenue generated").alias("revenue"),
        text_or_unknown(_raw("Customer demographics")).alias("customer_demographics"),
        whole("Stock levels").alias("stock_levels"),
        whole("Lead times").alias("lead_times"),
        whole("Order quantities").alias("order_quantities"),
        whole("Shipping times").alias("shipping_times"),
        text_or_unknown(_raw("Shipping carriers")).alias("shipping_carriers"),
        money("Shipping costs").alias("shipping_costs"),
        text_or_unknown(_raw("Supplier name")).alias("supplier_name"),
        text_or_unknown(_raw("Location")).alias("location"),
        money("Defect rates").alias("defect_rates"),
    )
    return dedup_supply_chain(typed, counted)


def retail_inventory(raw: DataFrame) -> DataFrame:
    typed = raw.dropna(subset=["Store ID", "Product ID", "Date"]).select(
        parse_date(_raw("Date"), no_date=None).alias("date"),
        _raw("Store ID").alias("store_id"),
        _raw("Product ID").alias("product_id"),
        number_or_zero(_raw("Units Sold"), "double").alias("sales"),
        number_or_zero(_raw("Inventory Level"), "int").alias("stock"),
    )
    return dedup_retail(typed.filter(F.col("date").isNotNull()))


def _greatest(df: DataFrame, keys: list[str], by: str, counted: bool = False) -> DataFrame:
    """The row per key with the greatest value; ``counted`` gives the same rows in the form for readers of keys only."""
    return keep_greatest(df, keys, [by]) if counted else keep_first(df, keys, [F.col(by).desc_nulls_last()])


def dedup_sales(df: DataFrame, counted: bool = False) -> DataFrame:
    return _greatest(df, ["order_id", "product_id", "order_date"], "shipment_date", counted)


def dedup_inventory(df: DataFrame, counted: bool = False) -> DataFrame:
    return _greatest(df, ["product_id"], "current_stock", counted)


def dedup_warehouse(df: DataFrame, measure: str) -> DataFrame:
    return _greatest(df, ["warehouse_id"], measure)


def dedup_supply_chain(df: DataFrame, counted: bool = False) -> DataFrame:
    return _greatest(df, ["sku"], "revenue", counted)


def dedup_retail(df: DataFrame) -> DataFrame:
    return _greatest(df, ["store_id", "product_id", "date"], "sales")
