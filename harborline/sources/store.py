"""Changes to stored Parquet tables: keyed merges and deletes that rewrite only the partitions they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators.keep import keep_first
from harborline.session import bucketed, dropped, remove, setting, written

BUCKETS = 64
BUCKET = "bucket"
PART, ROWS_PER_PART = "_part", 50_000
ALL_KEYS, OPEN_FILES, OPEN = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.maxConcurrentOutputFileWriters", "48"


def _replace_partitions(df: DataFrame, path: str, columns: list[str]) -> None:
    """Write a stored frame over the partitions that it has rows of; the others stay as they are.

    Spark writes to a staging folder and replaces partitions when the job is done, so the frame may be read from the same path.
    """
    df.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy(*columns).parquet(path)


def folder_of_row(file: str = "_metadata.file_path") -> Column:
    """Folder of the file that a row of a stored table is in."""
    return F.regexp_replace(file, "/[^/]*$", "").alias("folder")


def upsert(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    order: list[Column],
    key: str = "id",
    buckets: int = BUCKETS,
    ties: list[str] | None = None,
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> list[int]:
    """Merge rows into a table that is stored in buckets by a hash of their key; returns the buckets it rewrote.

    Of several incoming rows with a key the first in ``order`` (then the largest of the columns ``ties``, by default all) counts, and it replaces the stored one. Only buckets that get rows are
    read and rewritten. The merged rows are all in a staging folder before any file is replaced, so a lost executor or a
    job that fails in the merge leaves the stored table as it was. Their number is at most ``buckets``; a table should
    keep the number it began with.

    Both sides are dealt once, through tables, to parts of buckets that a task can sort. ``widen`` makes the stored
    columns of the incoming rows that count, when they are dealt: what is moved and ranked are the rows it starts from.
    """
    parts = max(1, -(-incoming.count() // (buckets * ROWS_PER_PART)))
    hashed = F.xxhash64(key)
    bucket = F.pmod(hashed, F.lit(buckets)).cast("int")
    part = (bucket * parts + F.pmod(F.shiftright(hashed, 32), F.lit(parts))).cast("int")
    deal = lambda rows, name: bucketed(rows.withColumn(PART, part), name, [PART], buckets * max(2, parts // 2))
    tables = [deal(incoming, "upsert_incoming")]
    dealt = spark.table(tables[0])
    touched = sorted(row[0] for row in dealt.select(bucket).distinct().collect())
    if not touched:
        dropped(spark, tables[0])
        return touched
    chosen = keep_first(dealt, [PART, key], order, ties=ties).drop(PART)
    merged = new = (chosen if widen is None else widen(chosen)).withColumn(BUCKET, bucket)
    if exists(spark, path):
        stored = spark.read.schema(new.schema).parquet(path).where(F.col(BUCKET).isin(touched))
        # stored rows may be wide: as tasks have few buckets of them they are written unsorted, and a part of the incoming keys fits in memory
        with setting(spark, OPEN_FILES, OPEN):
            tables.append(deal(stored, "upsert_stored"))
        rest = spark.table(tables[1]).join(dealt.select(PART, key).hint("shuffle_hash"), [PART, key], "left_anti")
        merged = rest.select(*new.columns).unionByName(new)
    # tables dealt by the part alone are joined by part and key as they are
    with setting(spark, ALL_KEYS, "false"), setting(spark, OPEN_FILES, OPEN):
        _replace_partitions(merged, path, [BUCKET])
    for table in tables:
        dropped(spark, table)
    return touched


def clear_partition(spark: SparkSession, path: str, column: str, value) -> int:
    """Empty one partition of a stored table: its folders go, no other file is touched. Returns how many folders went."""
    rows = spark.read.parquet(path).where(F.col(column).eqNullSafe(F.lit(value)))
    folders = [row[0] for row in rows.select(folder_of_row()).distinct().collect()]
    for folder in folders:
        remove(spark, folder, encoded=True)
    return len(folders)


def delete_rows(spark: SparkSession, path: str, condition: Column, partitions: list[str]) -> int:
    """Delete the rows of a stored table for which the condition is true, by copy on write of the partitions that hold any.

    Rows for which it is false or null stay. What stays of those partitions is written once, to the staging folder of a dynamic
    overwrite, which replaces their files when all of it is there; a partition of which nothing stays is removed. Returns how many
    partitions were rewritten or removed. What comes to the driver are partition folders.
    """
    table = spark.read.parquet(path)
    goes = F.coalesce(condition, F.lit(False))
    by_file = table.groupBy(*partitions, F.col("_metadata.file_path").alias("_file")).agg(F.count_if(goes).alias("_gone"), F.count_if(~goes).alias("_left"))
    sums = F.sum("_gone").alias("_gone"), F.sum("_left").alias("_left"), F.collect_set(folder_of_row("_file")).alias("folders")
    held = written(by_file.groupBy(*partitions).agg(*sums).where("_gone > 0"), "delete-held")
    touched = held.count()
    if not touched:
        return 0
    emptied = [row[0] for row in held.where("_left = 0").select(F.explode("folders")).collect()]
    rest = table.join(held, [table[name].eqNullSafe(held[name]) for name in partitions], "left_semi")
    _replace_partitions(rest.where(~goes), path, partitions)
    for folder in emptied:
        remove(spark, folder, encoded=True)
    return touched


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
