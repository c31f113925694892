"""Allow and block rules for URLs, matched by hashes of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import UPPER, as_row, field, let, unpacked

PREFIX_BYTES = 4


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the full digest and its first bytes; null or empty hosts are no rules."""
    rows = rules.select(F.translate("host", UPPER, UPPER.lower()).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    rows = rows.where((F.col("rule_host") != "") & F.col("verdict").isin("allow", "block"))
    rows = rows.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block wins over allow
    digest = expression(F.col("rule_host"), F.col("rule_path"))
    return rows.select("rule_host", "rule_path", "verdict", digest.alias("digest"), F.substring(digest, 1, 2 * PREFIX_BYTES).alias("short"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_path: int = 2048, url_col: str = "url") -> DataFrame:
    """Give every URL the verdict of the most specific rule that fits it.

    A rule fits its host and all subdomains if the path starts with the rule's path. Each distinct URL is expanded into all
    suffixes of its host and the prefixes of its path that have the length of some rule's path. The expressions meet the
    rules in an equi-join on the first bytes of their SHA-256, then the full digests must agree. The longest host and path
    together win; if two rules are equally long, the longer host, then block. Rules are a table of any size: Spark
    broadcasts it only if it is small enough, else it joins by the short hash and splits a crowded one.

    ``max_path`` bounds the lengths of rule paths; a longer one is an error, not ignored.

    Returns the input's columns, then ``host``, ``path``, ``rule`` (host and path of the rule, else null) and ``verdict``
    (``default`` if no rule fits). Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Repeated
    rows are each returned; an empty table gives an empty table, and without rules all get ``default``.
    """
    book = prepared_rules(rules)
    sizes = sorted(row["size"] for row in book.select(F.char_length("rule_path").alias("size")).distinct().limit(max_path + 2).collect())
    if sizes and sizes[-1] > max_path:
        raise ValueError(f"a rule's path is longer than {max_path}")

    packed = as_row(pages).select("row", field(url_col).alias("link"))
    urls = packed.select("link").where(F.col("link").isNotNull()).distinct()
    urls = urls.select("link", url_host(F.col("link")).alias("host"), url_path(F.col("link")).alias("path")).where(F.col("host") != "")

    def suffixes_of(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    suffixes = let(F.split("host", r"\."), suffixes_of)
    lengths = F.filter(F.array(*(F.lit(n) for n in sizes or [0])), lambda n: n <= F.char_length("path"))
    expanded = urls.select("link", "path", F.explode(suffixes).alias("suffix"))
    expanded = expanded.select("link", "suffix", F.explode(F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"))
    digest = expression(F.col("suffix"), F.col("prefix"))
    expanded = expanded.select("link", F.substring(digest, 1, 2 * PREFIX_BYTES).alias("short"), digest.alias("full"))
    hits = expanded.join(book, "short").where(F.col("full") == F.col("digest"))
    weight = F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("size"), F.char_length("rule_host").alias("host"), "verdict")
    best = hits.groupBy("link").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), weight).alias("best"))
    judged = packed.join(best, "link", "left")
    return unpacked(
        judged,
        host=url_host(F.col("link")),
        path=url_path(F.col("link")),
        rule=F.col("best.rule"),
        verdict=F.coalesce("best.verdict", F.lit(default)),
    )
