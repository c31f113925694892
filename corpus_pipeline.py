"""From raw documents to packed training batches, one operator after the other.

Each stage takes the documents its predecessor kept and returns documents with the same columns; the last returns packed
sequences. Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborline.llm import language, line_dedup, mixing, ngram_join, packing
from harborline.session import written

# A document without a letter, or with less than this share of its letters in one language that the model knows, is rejected.
MIN_LANGUAGE_SHARE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: reject documents without a main language; a missing ``lang`` is filled in.

    The model learns from the labelled documents outside the held-out quarter (CRC-32 of the id modulo 4 is 2). If documents
    have letters but none of those has a label, no language can be told, which is an error.
    """
    taught = docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("doc_id").isNotNull()).select("text", "lang")
    model = language.train(taught)
    if not model.langs and not docs.where(F.col("text").rlike(r"\p{L}")).isEmpty():
        raise ValueError("no labelled document outside the held-out quarter: no language can be told")
    found = language.identify(docs, model)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line deduplication: texts without their repeated lines; documents that had nothing else go."""
    found = line_dedup.dedup_lines(docs)
    empty = (F.col("n_dropped") > 0) & (line_dedup.line_key(F.col("text")) == "")
    return found.where(~empty).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the smallest id of each near-duplicate group, once.

    Documents without an id are in no group and stay.
    """
    groups = ngram_join.near_documents(docs.select("doc_id", "text"))
    lowest = groups.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    one = W.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), "text")
    kept = docs.join(lowest, "doc_id", "left_semi").withColumn("nth_", F.row_number().over(one)).where("nth_ = 1")
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication: sources weighted by the square root of their size, in a global random order."""
    return mixing.mix(docs, temperature=0.5, seed=17).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: sequences of at most 2,048 words in batches of 65,536 by optimal length buckets."""
    return packing.pack(docs, buckets=8, max_tokens=2048, batch_tokens=65536, seed=23)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_group),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]
# The first stage learns a model, which SQL cannot express; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
