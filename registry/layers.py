"""Lazily built silver and gold frames of one data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.operators.rolling import day_slices, heavy_keys
from harborline.plans import gold, silver
from harborline.session import bucketed, dropped, undealt, written
from harborline.sources import bindings, files

AS_OF = bindings.AS_OF


class Layers:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return bindings.table(self.spark, self.folder, name)

    @cached_property
    def raw_sales(self) -> DataFrame:
        return bindings.raw_sales(self.spark, self.folder)

    @cached_property
    def raw_inventory(self) -> DataFrame:
        return bindings.raw_inventory(self.spark, self.folder)

    @cached_property
    def raw_supply(self) -> DataFrame:
        return bindings.raw_supply(self.spark, self.folder)

    @cached_property
    def raw_retail(self) -> DataFrame:
        return bindings.raw_retail(self.spark, self.folder)

    def raw_warehouses(self, measure: str) -> DataFrame:
        return bindings.raw_warehouses(self.spark, self.folder, measure)

    @cached_property
    def all_sales(self) -> DataFrame:
        return bindings.sales(self.spark, self.folder)

    @cached_property
    def all_supply(self) -> DataFrame:
        return bindings.supply(self.spark, self.folder)

    @cached_property
    def sales(self) -> DataFrame:
        return silver.dedup_sales(self.all_sales)

    @cached_property
    def inventory(self) -> DataFrame:
        return bindings.inventory(self.spark, self.folder)

    @cached_property
    def supply(self) -> DataFrame:
        return silver.dedup_supply_chain(self.all_supply)

    @cached_property
    def retail(self) -> DataFrame:
        return bindings.retail(self.spark, self.folder)

    @cached_property
    def joined(self) -> DataFrame:
        return gold.joined_sales(self.sales, self.inventory, self.supply)

    @cached_property
    def sales_ml(self) -> DataFrame:
        return self.joined.drop("product_type")

    @cached_property
    def sales_ml_by_month(self) -> DataFrame:
        """The same rows, those of a month together, for tables stored by month."""
        return gold.joined_sales(self.sales, self.inventory, self.supply, files.by_month).drop("product_type")

    @cached_property
    def inventory_ml(self) -> DataFrame:
        return gold.inventory_ml_clean(self.retail, self.inventory)

    @cached_property
    def inventory_features(self) -> DataFrame:
        return gold.inventory_features(self.inventory_ml, AS_OF)

    @cached_property
    def heavy_customers(self) -> DataFrame:
        # rows before deduplication are enough to tell which customers are heavy
        orders, lines = self.table("orders"), self.table("lineitem")
        owned = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("customer_id")
        )
        return heavy_keys(owned, ["customer_id"])

    @cached_property
    def slices(self) -> DataFrame:
        # orders stand in for order rows: the split needs about the rows and ids of each day, not exact counts
        return written(day_slices(self.table("orders"), "o_orderdate", "o_orderkey"), "day-slices")

    @cached_property
    def rows(self) -> DataFrame:
        return gold.delivery_rows(self.joined, AS_OF, self.heavy_customers, self.slices)

    @cached_property
    def delivery(self) -> DataFrame:
        return gold.delivery_features(self.rows)

    @cached_property
    def flat(self) -> DataFrame:
        return gold.flat_order_record(self.rows)

    @cached_property
    def history(self) -> DataFrame:
        return gold.integrated(self.rows, self.inventory_features)

    @cached_property
    def events(self) -> DataFrame:
        return bindings.order_events(self.table("events"))

    @cached_property
    def stored(self) -> Layers:
        """The same layers over order rows that are joined once and stored, for readers of the moving windows."""
        return StoredLayers(self.spark, self.folder)


LINES_PER_BUCKET = 1_500_000


class StoredLayers(Layers):
    """The moving windows read the joined order rows several times; here those reads are scans of a table.

    Rows go to the windows of customers and of shipping modes through tables in buckets, which take a third of the space of shuffle files.
    """

    @cached_property
    def buckets(self) -> int:
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // LINES_PER_BUCKET))

    def _gathered(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        self.tables = [*getattr(self, "tables", []), bucketed(rows, f"rows_by_{keys[0]}", keys, self.buckets)]
        return self.spark.table(self.tables[-1])

    @cached_property
    def all_sales(self) -> DataFrame:
        return bindings.sales(self.spark, self.folder, self._gathered)

    @cached_property
    def joined(self) -> DataFrame:
        return self._gathered(super().joined, ["customer_id"])

    @cached_property
    def rows(self) -> DataFrame:
        joined, heavy = self.joined, self.heavy_customers
        if heavy is not None:  # a bucket would bring all rows of a heavy customer to one task
            joined = undealt(self.spark, self.tables[-1])
        found = gold.delivery_rows(joined, AS_OF, heavy, self.slices, gather=self._gathered)
        # the windows are read from the last two tables; frames of the tables before them are made anew if they are asked for
        while len(self.tables) > 2:
            dropped(self.spark, self.tables.pop(0))
        for name in ("all_sales", "sales", "joined", "heavy_customers"):
            self.__dict__.pop(name, None)
        return found

    @cached_property
    def heavy_customers(self) -> DataFrame | None:
        """None where no customer is heavy: then no row is read again for blocks of customers."""
        heavy = heavy_keys(self.joined, ["customer_id"])
        return None if heavy.isEmpty() else written(heavy, "heavy-customers")


def comparable(df: DataFrame) -> DataFrame:
    """Plain output types: decimals as doubles, dates and timestamps as ISO text, flags as integers."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.BooleanType):
            column = column.cast("int")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def digits(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Round columns whose last bits depend on the order in which doubles were added."""
    return df.withColumns({name: F.round(name, places) for name in names})
