"""Retrieval over order records and documents as batch jobs keyed by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions.display import plain
from harborline.operators.keep import keep_first
from harborline.plans.gold import FLAT_RECORD

# Candidate factor, least similarity, context size, urgent terms and default labels.
CANDIDATES_PER_RESULT, LEAST_SCORE = 3, 0.65
CONTEXT_CHARS, LEAST_RECORD_CHARS = 12_000, 1_000
URGENT_TERMS = [
    "emergency",
    "urgent",
    "critical",
    "severe",
    "incident",
    "outage",
    "stockout",
    "stock out",
    "blocked",
    "failure",
    "disruption",
    "delay",
]
MISSING, DEFAULT_SOURCE, SEPARATOR = "N/A", "Knowledge Base", "\n\n---\n\n"


def field_text(df: DataFrame, name: str) -> Column:
    """Text of a field: fractions with up to four decimals, everything else as it is, NULL as N/A."""
    fraction = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    value = plain(F.col(name)) if fraction else F.col(name).cast("string")
    return F.coalesce(value, F.lit(MISSING))


def chunk_text(df: DataFrame) -> Column:
    lines = [
        F.concat(F.lit(f"{name.replace('_', ' ').title()}: "), field_text(df, name))
        for name in FLAT_RECORD
        if name in df.columns
    ]
    return F.concat_ws("\n", F.lit("Order record:"), *lines)


def chunk_metadata(df: DataFrame) -> Column:
    pairs = [part for name in df.columns for part in (F.lit(name), field_text(df, name))]
    return F.create_map(*pairs)


def chunk_id(records: DataFrame) -> Column:
    return F.concat(F.lit("order_"), field_text(records, "order_id"), F.lit("_product_"), field_text(records, "product_id"))


def build_chunks(records: DataFrame) -> DataFrame:
    """(id, text, metadata) per order record."""
    return records.select(
        chunk_id(records).alias("id"), chunk_text(records).alias("text"), chunk_metadata(records).alias("metadata")
    )


def latest_chunks(chunks: DataFrame, order: list[Column]) -> DataFrame:
    """One chunk per id, the last in the given order (newest first)."""
    return keep_first(chunks, ["id"], order, ties=["text"])


def latest_texts(records: DataFrame, order: list[Column]) -> DataFrame:
    """(id, text) of ``latest_chunks`` from the records themselves: per id the first in the given order, of equals the greatest text.

    Records are ranked by their own columns, and texts built of those left where they are: neither texts nor metadata
    are shuffled or sorted. Records that have their ``id`` already keep it, so that a table dealt by it is not shuffled again.
    """
    named = records if "id" in records.columns else records.withColumn("id", chunk_id(records))
    ranked = named.withColumn("_rank", F.rank().over(Window.partitionBy("id").orderBy(*order)))
    first = ranked.filter("_rank = 1")
    return first.select("id", chunk_text(first).alias("text")).groupBy("id").agg(F.max("text").alias("text"))


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that an interrupted load has not written yet."""
    return chunks.join(done.select("id"), "id", "left_anti")


def as_vectors(documents: DataFrame) -> DataFrame:
    """Documents as (id, content, source); the id is a stable hash of the content. Empty contents are kept, NULL counts as empty."""
    content = F.coalesce("content", F.lit(""))
    digest = F.sha2(content.cast("binary"), 256)
    source = F.coalesce("source", F.lit("unknown"))
    return documents.select(F.concat(F.lit("upload_"), digest).alias("id"), content.alias("content"), source.alias("source"))


def documents_to_vectors(documents: DataFrame) -> DataFrame:
    """Each content once, with the first of its sources by name."""
    return keep_first(as_vectors(documents), ["id"], [F.col("source")])


def corpus_status(corpus: DataFrame, namespace: str = "namespace") -> DataFrame:
    return corpus.groupBy(namespace).agg(F.count(F.lit(1)).alias("documents_count"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def rerank(candidates: DataFrame, k: int = 5, least: float = LEAST_SCORE) -> DataFrame:
    """From the best k * 3 candidates per query (query_id, id, score, content): those similar enough, non-empty and
    not repeating an earlier text, at most k."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    same_text = Window.partitionBy("query_id", "content").orderBy(F.col("score").desc(), "id")
    return (
        candidates.withColumn("_at", F.row_number().over(best))
        .filter(F.col("_at") <= k * CANDIDATES_PER_RESULT)
        .withColumn("content", strip(F.col("content")))
        .filter((F.col("score") >= least) & (F.col("content") != ""))
        .withColumn("_copy", F.row_number().over(same_text))
        .filter("_copy = 1")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .drop("_at", "_copy")
    )


def source_label(metadata: Column, match_id: Column) -> Column:
    """First non-empty of table, source, filename; else the order; else the id; else a default."""
    filled = lambda text: F.when(text != "", text)
    named = [filled(metadata[name]) for name in ("table", "source", "filename")]
    order = filled(metadata["order_id"])
    return F.coalesce(*named, F.concat(F.lit("Order "), order), filled(match_id), F.lit(DEFAULT_SOURCE))


def confidence(matches: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Mean similarity per query within 0..1, two digits; 0 for a query without matches."""
    mean = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("score")))
    scored = matches.groupBy("query_id").agg(F.round(mean.cast("decimal(18,9)"), 2).cast("double").alias("confidence"))
    if queries is None:
        return scored
    return queries.select("query_id").join(scored, "query_id", "left").fillna(0.0, ["confidence"])


def is_urgent(query: Column) -> Column:
    return F.lower(query).rlike("|".join(URGENT_TERMS))


def _cut(section: Column, allowed: Column) -> Column:
    """The section, or its first ``allowed`` characters up to the last space, with an ellipsis."""
    head = F.substring(section, F.lit(1), allowed)
    back = F.locate(" ", F.reverse(head))
    whole_words = F.when(back > 0, F.substring(head, F.lit(1), allowed - back)).otherwise(head)
    return F.when(F.length(section) > allowed, F.concat(whole_words, F.lit("…"))).otherwise(section)


def context_pack(matches: DataFrame) -> DataFrame:
    """One context per query from its ranked matches (rank, source, content), within a fixed number of characters.

    The budget is the feature: each record gets an equal share of it. A query has as many matches as were kept for
    it (a handful), so its array stays small.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "source", strip(F.col("content")).alias("content"))))
    packed = matches.groupBy("query_id").agg(ordered.alias("records"))
    share = F.greatest(F.lit(LEAST_RECORD_CHARS), F.floor(F.lit(CONTEXT_CHARS) / F.size("records")).cast("int"))
    start = F.struct(
        F.lit(0).alias("seen"), F.lit(CONTEXT_CHARS).alias("left"), F.lit(None).cast("string").alias("text")
    )

    def add(state: Column, record: Column) -> Column:
        number = state["seen"] + 1
        heading = F.concat(F.lit("[Record "), number, F.lit(" | Source: "), record["source"], F.lit("]\n"))
        section = _cut(F.concat(heading, record["content"]), F.least(F.col("_share"), state["left"]))
        used = (record["content"] != "") & (state["left"] > 0)
        return F.struct(
            number.alias("seen"),
            F.when(used, state["left"] - F.length(section)).otherwise(state["left"]).alias("left"),
            F.when(used, F.concat_ws(SEPARATOR, state["text"], section)).otherwise(state["text"]).alias("text"),
        )

    folded = F.aggregate("records", start, add, lambda state: F.coalesce(state["text"], F.lit("")))
    return packed.withColumn("_share", share).select("query_id", folded.alias("context"))
