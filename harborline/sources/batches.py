"""Long work over a keyed table in numbered batches, which goes on after the last finished one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.sources import store

BATCH = "batch"


def batch_of(key: str, batches: int) -> Column:
    """Number of a row's batch: the first 32 bits of its key's MD5, so that it is the same in every run."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % batches).cast("int")


def stage(rows: DataFrame, path: str, batches: int, key: str = "id") -> None:
    """Store the rows in one folder per batch; every task adds a file to the folder of each batch that it has rows of, no row is shuffled."""
    rows.withColumn(BATCH, batch_of(key, batches)).write.option("compression", "zstd").partitionBy(BATCH).parquet(path)


def finished(spark: SparkSession, out: str) -> set[int]:
    """Numbers of the batches whose results are complete."""
    path = f"{out}/finished"
    return {row[0] for row in spark.read.parquet(path).distinct().collect()} if store.exists(spark, path) else set()


def run(spark: SparkSession, staged: str, out: str, work: Callable[[DataFrame], DataFrame], at_once: int = 4, most: int | None = None) -> list[int]:
    """Apply ``work`` to the staged batches that are not finished, in the order of their numbers; returns those done now.

    ``work`` gets rows of ``at_once`` batches and must keep their ``batch``. Its result is written to ``out/rows`` in place of what an ended run
    may have left of these batches, then their numbers are added to the list ``out/finished``. What is finished is told by that list
    alone: no ids are compared, finished batches are neither read nor written. ``most`` ends a call after so many batches.
    Only batch numbers come to the driver.
    """
    table, done = spark.read.parquet(staged), finished(spark, out)
    left = sorted(row[0] for row in table.select(BATCH).distinct().collect() if row[0] not in done)[:most]
    for i in range(0, len(left), at_once):
        now = left[i : i + at_once]
        results = work(table.where(F.col(BATCH).isin(now)))
        results.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy(BATCH).parquet(f"{out}/rows")
        spark.createDataFrame([(n,) for n in now], f"{BATCH} int").coalesce(1).write.mode("append").parquet(f"{out}/finished")
    return left
