"""Packing documents into batches of one padded length each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from harborline.llm.common import as_row, field, let, unit, words
from harborline.session import written


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges with the least total padding; ties take the smaller bounds.

    cost[b][i] is the least padding of the i shortest lengths in b ranges; the last range starts after some j < i.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[n] for n in lengths], dtype=np.int64)
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    size, steps = len(lengths), []
    far = np.int64(1) << 62
    cost = np.full(size + 1, far)
    cost[0] = 0
    for _ in range(min(buckets, size)):
        new, back = np.full(size + 1, far), np.zeros(size + 1, dtype=np.int64)
        for i in range(1, size + 1):
            padding = lengths[i - 1] * (rows[i] - rows[:i]) - (tokens[i] - tokens[:i])
            total = np.where(cost[:i] < far, cost[:i] + padding, far)
            back[i] = int(np.argmin(total))
            new[i] = total[back[i]]
        steps.append(back)
        cost = new
    bounds, i = [], size
    for back in reversed(steps):
        bounds.append(int(lengths[i - 1]))
        i = back[i]
    return bounds[::-1]


def chosen(bounds: list[int], value: Column, results: list) -> Column:
    """The result of the first bound that is not below the value."""
    out = F.lit(results[-1])
    for bound, result in reversed(list(zip(bounds, results))[:-1]):
        out = F.when(value <= bound, F.lit(result)).otherwise(out)
    return out


def pack(
    docs: DataFrame,
    buckets: int = 8,
    max_tokens: int = 2048,
    batch_tokens: int = 65536,
    rows_per_shard: int = 4096,
    seed: int = 23,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """Cut documents into sequences of at most ``max_tokens`` tokens and batch sequences of similar length.

    Tokens are words by default; ``tokens`` may give another array column over ``text``. A document longer than ``max_tokens``
    becomes several sequences, none of its tokens is dropped. Bucket bounds come from dynamic programming over the
    histogram of all sequence lengths, which has at most ``max_tokens`` entries. A batch of a bucket holds as many sequences,
    padded to the bucket's bound, as fit into ``batch_tokens``. Inside a bucket sequences stand in hash order, numbered
    exactly: hash ranges ("shards") of about ``rows_per_shard`` rows are numbered on their own and shifted by the rows of
    the ranges before, so no task holds a bucket, and only the last batch of a bucket may be incomplete.

    Returns one row per sequence: id column, ``segment`` (from 0), ``n_tokens``, ``bucket``, ``bound``, ``batch``, ``slot``
    (both from 0) and ``text`` (tokens joined by a space).

    Null texts and texts without a token give no sequence. A null id is packed like others. Repeated rows are all packed.
    An empty table gives an empty table. Columns other than id and text are not read.
    """
    if batch_tokens < max_tokens:
        raise ValueError("a batch must hold the longest sequence")
    listed = tokens if tokens is not None else words(F.col("text"))
    base = as_row(docs).select(field(id_col).alias("id"), field(text_col).alias("text"))

    def starts(number: Column) -> Column:
        return F.when(number > 0, F.sequence(F.lit(0), F.ceil(number / max_tokens).cast("int") - 1))

    def sizes_of(number: Column) -> Column:
        return F.transform(starts(number), lambda i: F.least(F.lit(max_tokens), number - i * max_tokens))

    def parts_of(list_: Column) -> Column:
        return F.transform(starts(F.size(list_)), lambda i: F.slice(list_, i * max_tokens + 1, F.lit(max_tokens)))

    def place() -> Column:
        return unit(F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("segment").cast("string"))

    lengths = base.select("id", F.posexplode(let(F.size(listed), sizes_of)).alias("segment", "n_tokens"))
    lengths = written(lengths.select("n_tokens", place().alias("place")), "sequence-lengths")
    histogram = {row["n_tokens"]: row["rows"] for row in lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).collect()}
    bounds = best_bounds(histogram, buckets) if histogram else [max_tokens]
    held = [sum(n for length, n in histogram.items() if low < length <= high) for low, high in zip([0, *bounds], bounds)]
    shards = [max(1, -(-n // rows_per_shard)) for n in held]

    pieces = base.select("id", F.posexplode(let(listed, parts_of)).alias("segment", "part"))
    pieces = pieces.select("id", "segment", F.size("part").alias("n_tokens"), F.array_join("part", " ").alias("text"), place().alias("place"))
    bucket = chosen(bounds, F.col("n_tokens"), list(range(len(bounds)))).alias("bucket")
    shard = F.floor(F.col("place") * chosen(bounds, F.col("n_tokens"), shards)).cast("long").alias("shard")

    order = W.partitionBy("bucket", "shard").orderBy("place", "id", "segment", "text")
    placed = pieces.select("*", bucket, shard).withColumn("nth", F.row_number().over(order))
    sizes = written(lengths.groupBy(bucket, shard).agg(F.count(F.lit(1)).alias("rows")), "shard-sizes")
    before = W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("nth") - 1
    room = chosen(bounds, F.col("n_tokens"), [batch_tokens // bound for bound in bounds])
    return placed.join(sizes, ["bucket", "shard"]).select(
        F.col("id").alias(id_col),
        "segment",
        "n_tokens",
        "bucket",
        chosen(bounds, F.col("n_tokens"), bounds).alias("bound"),
        F.floor(at / room).cast("long").alias("batch"),
        (at % room).cast("int").alias("slot"),
        "text",
    )
