"""Session settings and the shared folder used for checkpoints and written layers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on (time zone) or that let Spark re-plan at run time (adaptive execution).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Options for writers of very many files. On file: paths Hadoop puts a checksum file beside every file and, without its native
# library, starts a chmod process several times per file, which takes longer than the file; other file systems are not affected.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def build_session(app: str = "harborline", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine, since there driver and executors share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="harborline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, read by every later step.

    Losing an executor then costs a re-read of some files instead of the whole lineage.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> str:
    """The frame as a Parquet table in the shared folder whose files are dealt by a hash of the keys, as a shuffle would deal them.

    Windows and joins by these keys read it without a shuffle. Rows are stored by column, so they take much less space
    than in shuffle files; a task writes a file for every bucket that it has rows of. Gives the name of the table.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    options = {"path": os.path.join(shared_folder(df.sparkSession), table), "compression": "zstd", **PLAIN_LOCAL}
    df.write.format("parquet").options(**options).bucketBy(buckets, *keys).saveAsTable(table)
    return table


def undealt(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a ``bucketed`` table read as plain files, so that Spark can deal them by other columns."""
    return spark.read.schema(spark.table(table).schema).parquet(os.path.join(shared_folder(spark), table))


def dropped(spark: SparkSession, table: str) -> None:
    """Drop a ``bucketed`` table and its files, when nothing reads it any more."""
    spark.sql(f"DROP TABLE {table}")
    remove(spark, os.path.join(shared_folder(spark), table))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the statements of a block; afterwards it is what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def remove(spark: SparkSession, path: str, encoded: bool = False) -> None:
    """Delete a folder of the shared file system, whatever system that is; nothing happens if it is not there.

    ``encoded`` paths are written as URIs, like those that Spark gives for the file of a row.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(path) if encoded else path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
