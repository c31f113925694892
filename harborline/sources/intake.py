"""Text files into a stored corpus: only new or changed files are read, each content is kept once."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.plans.retrieval import as_vectors
from harborline.session import written
from harborline.sources import store

TEXT_FILES = "*.{txt,md}"
FILE_KEY = ["path", "modificationTime", "length"]
LATE = timedelta(hours=1)
NAME_TASKS = 64


def text_files(spark: SparkSession, folder: str, since=None) -> DataFrame:
    """The .txt and .md files of a folder tree (path, modificationTime, length, content); ``since`` is a time before which files are not listed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", TEXT_FILES)
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.load(folder)


def ingest(spark: SparkSession, folder: str, corpus: str, late: timedelta = LATE) -> int:
    """Take the files of a folder tree that an earlier call has not taken into a corpus; returns how many those are.

    ``corpus/documents`` holds (id, content, source) in buckets by the id, which is a hash of the content, so a content is there once,
    with the name of the file that brought it last. ``corpus/files`` lists the files taken, by path, time of modification and length.
    The newest time in that list, less ``late`` for files that were slow to appear, is the mark before which no file is looked at;
    after it only those not in the list are read. The list is written last: a call that failed is repeated as a whole and
    leads to the same documents. A changed file brings a further document. Bytes that are not UTF-8 become the
    replacement character; files of no bytes are passed over by Spark's file readers,
    files of 2 GB or more are an error.
    """
    if store.exists(spark, f"{corpus}/files"):
        taken = spark.read.parquet(f"{corpus}/files")
        since = taken.agg(F.max("modificationTime")).first()[0] - late
        seen = text_files(spark, folder, since)
        # names first, which opens no file and takes few tasks; then no file older than the oldest new one is opened
        names = seen.select(*FILE_KEY).coalesce(NAME_TASKS)
        keys = written(names.join(taken.where(F.col("modificationTime") >= F.lit(since)), FILE_KEY, "left_anti"), "new-keys")
        oldest = keys.agg(F.min("modificationTime")).first()[0]
        if oldest is None:
            return 0
        found = seen.where(F.col("modificationTime") >= F.lit(oldest)).join(keys, FILE_KEY, "left_semi")
    else:
        found = text_files(spark, folder)
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    name = F.element_at(F.split("path", "/"), -1).alias("source")
    new = written(found.select(*FILE_KEY, text, name), "new-files")
    if not (count := new.count()):
        return 0
    store.upsert(spark, f"{corpus}/documents", as_vectors(new), [F.col("source")], ties=["source"])
    new.select(*FILE_KEY).write.mode("append").parquet(f"{corpus}/files")
    return count


def documents(spark: SparkSession, corpus: str) -> DataFrame:
    return spark.read.parquet(f"{corpus}/documents").drop(store.BUCKET)
