"""Dimension joins of the feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The department that is linked to supplier statistics, and the product types it covers.
LINKED_DEPARTMENT = "Health and Beauty"
LINKED_TYPES = ("haircare", "skincare", "cosmetics")


def with_stock(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Left join on product. The stock side has one row per product; Spark measures it and broadcasts it or
    shuffles both sides, where adaptive execution splits a hot product."""
    return sales.join(inventory, "product_id", "left")


def with_stock_by_text(retail: DataFrame, inventory: DataFrame) -> DataFrame:
    """Left join of retail rows to stock on the textual product id."""
    stock = inventory.withColumn("product_id", F.col("product_id").cast("string"))
    return retail.withColumn("product_id", F.col("product_id").cast("string")).join(stock, "product_id", "left")


def with_supplier_statistics(sales: DataFrame, statistics: DataFrame) -> DataFrame:
    """Left join by department; one row of the linked department becomes one row per product type.

    The rule "department X matches types a, b, c" is written as a link table, which makes the join an equi-join.
    That table times one statistics row per type has at most three rows, so it is always broadcast.
    """
    links = ", ".join(f"('{LINKED_DEPARTMENT}', '{kind}')" for kind in LINKED_TYPES)
    linked = sales.sparkSession.sql(f"SELECT * FROM VALUES {links} AS link(department, product_type)")
    return sales.join(F.broadcast(linked.join(statistics, "product_type")), "department", "left")
