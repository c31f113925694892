"""Catalog tables and row counts per layer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.sources.files import RAW_FILES, read_csv_as_text


def table_name(*parts: str) -> str:
    """Dotted name of validated identifiers (catalog, schema, table)."""
    for part in parts:
        if not re.fullmatch(r"[A-Za-z_]\w*", part):
            raise ValueError(f"not an identifier: {part!r}")
    return ".".join(parts)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create the table or replace its contents; with a path the files live there."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {table_name(*old.split('.'))} RENAME TO {table_name(*new.split('.'))}")


def list_tables(spark: SparkSession, schema: str = "default") -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {table_name(*schema.split('.'))}")


def load_bronze(spark: SparkSession, folder: str, schema: str = "default", root: str | None = None) -> list[str]:
    """Load every raw file that is present into its bronze table, untouched; returns the loaded names."""
    loaded = []
    for name, file_name in RAW_FILES.items():
        try:
            raw = read_csv_as_text(spark, f"{folder}/{file_name}")
        except Exception as missing:  # only an absent file is skipped
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            continue
        replace_table(raw, table_name(*schema.split("."), name), f"{root}/{name}" if root else None)
        loaded.append(name)
    return loaded


def without_rows(df: DataFrame, condition) -> DataFrame:
    """What a DELETE with that condition leaves: rows where it is false or NULL."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def row_counts(layers: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """(layer, table, rows) for every table of every layer, counted in one job."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(layer).alias("layer"), F.lit(name).alias("table"), "rows"
        )
        for layer, frames in layers.items()
        for name, frame in frames.items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


def status(df: DataFrame, date_column: str = "order_date") -> DataFrame:
    """Row count and latest date of the rows that have a date."""
    return df.filter(F.col(date_column).isNotNull()).agg(
        F.count(F.lit(1)).alias("row_count"), F.max(date_column).alias("latest_date")
    )
