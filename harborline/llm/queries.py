"""The registered queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import language, line_dedup, mixing, ngram_join, packing, passage_dedup, secrets, sql, substring_dedup, token_alignment, topk, url_filter, vector_dedup, whitening
from harborline.session import written

Query = Callable[[SparkSession, str], DataFrame]

# The rules that the URL query applies.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"

TOKENIZERS = "/opt/tokenizers"  # folder of the vocabulary files

MIX = {"temperature": 0.5, "seed": 17}
PACK = {"buckets": 8, "max_tokens": 2048, "batch_tokens": 65536, "seed": 23}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ranges(spans: str) -> Column:
    """The spans that went, as ``start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(spans)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = passage_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), size=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), ranges("removed"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules, DEFAULT_VERDICT).drop("url")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    out = packing.pack(table(spark, folder, "documents"), **PACK)
    return out.withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"), **MIX)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return out.select("doc_id", "source", "copy", F.col("n_copies").cast("long").alias("n_copies"), "shuffle_key", digest)


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_documents(table(spark, folder, "documents").select("doc_id", "text"))


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vec"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.train(docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("doc_id").isNotNull()).select("text", "lang"))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.remove_passages(table(spark, folder, "documents").select("doc_id", "text"), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), ranges("removed"))


def op12_token_alignment(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    files = token_alignment.Tokenizers.read(tokenizers)
    found = token_alignment.align(table(spark, folder, "documents").select("doc_id", "text"), files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    n_groups = F.when(F.col("groups") == "", 0).otherwise(F.char_length("groups") - F.char_length(F.replace("groups", F.lit(";"), F.lit(""))) + 1)
    found = written(found.select("doc_id", "n_a", "n_b", n_groups.cast("long").alias("n_groups"), digest, "links"), "aligned")
    return token_alignment.score(found, files).drop("links")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", whitening.on_grid(F.col("embedding")).alias("vec"))
    out = whitening.whiten(vectors, components=8)
    rows = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    component = (F.col("at") + 1).cast("int").alias("component")
    return rows.select("vec_id", component, "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_packing": op5_packing,
        "op6_secret_scan": op6_secret_scan,
        "op7_ngram_join": op7_ngram_join,
        "op8_mixing": op8_mixing,
        "op9_topk": op9_topk,
        "op10_language_id": op10_language_id,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_token_alignment": op12_token_alignment,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": sql.LINES,
        "op2_suffix_dedup": sql.REPEATS,
        "op3_url_filter": sql.urls(RULES, DEFAULT_VERDICT),
        "op4_embedding_dedup": sql.VECTORS,
        "op5_packing": sql.packed(PACK["buckets"], PACK["max_tokens"], PACK["batch_tokens"], PACK["seed"]),
        "op7_ngram_join": sql.NEAR,
        "op8_mixing": sql.mixed(MIX["temperature"], MIX["seed"], mixing.PIECE),
        "op9_topk": sql.TOP,
        "op11_substring_dedup": sql.PASSAGES,
    }
