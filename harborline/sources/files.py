"""CSV, text and Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw file of each bronze table and the columns the silver layer reads from it.
RAW_FILES = {
    "bronze_inventory_stock_data": "Inventory_Stock_Data.csv",
    "bronze_sales_shipment_data": "Sales_Shipment_Data.csv",
    "bronze_retail_store_inventory": "retail_store_inventory.csv",
    "bronze_supply_chain_data": "supply_chain_data.csv",
    "bronze_warehouse_district_store": "warehouse_district_store.csv",
    "bronze_warehouse_national_central_medical_store": "warehouse_national_central_medical_store.csv",
    "bronze_warehouse_regional_warehouse": "warehouse_regional_warehouse.csv",
}


def read_csv_as_text(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column kept as text; typing is the silver layer's job.

    Without a schema option and without inference Spark reads only the header line up front.
    """
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a given schema; columns are matched to the header by name."""
    raw = read_csv_as_text(spark, path)
    kept = [field for field in schema.fields if field.name in raw.columns]
    return raw.select(*(F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name) for field in kept))


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per .txt or .md file, its whole text and its file name; other types are skipped."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{txt,md}")
        .text(folder, wholetext=True)
        .select(F.col("value").alias("content"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"))
    )


def by_month(df: DataFrame, date_column: str = "order_date") -> DataFrame:
    """The rows of each month of a date together.

    The rebalance hint lets adaptive execution cut a month that is larger than the advisory partition size into several tasks
    and merge small ones.
    """
    months = {"_year": F.year(date_column), "_month": F.month(date_column)}
    return df.withColumns(months).hint("rebalance", *months).drop(*months)


def write_partitioned(df: DataFrame, path: str, date_column: str = "order_date", gathered: bool = False) -> None:
    """Parquet partitioned by year and month of a date, so month filters read only their folders.

    Rows are gathered ``by_month`` first, unless they are ``gathered`` already.
    """
    rows = df if gathered else by_month(df, date_column)
    dated = rows.withColumn("part_year", F.year(date_column)).withColumn("part_month", F.month(date_column))
    dated.write.mode("overwrite").option("compression", "zstd").partitionBy("part_year", "part_month").parquet(path)
