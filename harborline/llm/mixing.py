"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import as_row, field, unit, unpacked
from harborline.session import written

# A rate above this is the sum of several Poisson numbers with an equal share each, so that exp(-rate) keeps its precision.
PIECE = 32.0


def poisson_table(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a Poisson number of mean ``rate`` (at most PIECE), until nothing measurable is left."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("sums"))
    end = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * rate / k)).alias("sums"),
        ),
    )
    return end["sums"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None, source_col: str = "source") -> DataFrame:
    """Per source its number of rows and the mean repetition rate that gives it its target share of ``total`` rows.

    ``weights`` names the target share of each source (in any unit; a source not named gets none, a missing source is
    ignored). Without it a source's share follows rows ** temperature: 1 keeps the proportions, 0 makes sources equal.
    ``total`` is the wanted number of rows, by default the number of input rows.
    """
    sizes = written(docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count(F.lit(1)).alias("n")), "source-sizes")
    if weights is None:
        wanted = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        wanted = F.lit(0.0)
        for name, weight in weights.items():
            wanted = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(wanted)
    sizes = sizes.withColumn("wanted", wanted)
    sums = sizes.agg(F.sum("n").alias("n"), F.sum("wanted").alias("wanted")).first()
    goal, share = float(sums["n"] or 0) if total is None else float(total), float(sums["wanted"] or 0) or 1.0
    rates = sizes.withColumn("rate", F.lit(goal) * F.col("wanted") / F.lit(share) / F.col("n"))
    rates = rates.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int"))
    return rates.withColumn("cdf", poisson_table(F.col("rate") / F.col("pieces"))).select("source", "n", "rate", "pieces", "cdf")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    total: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Repeat every document a Poisson number of times, with its source's rate as the mean, and shuffle globally.

    The number is the inverse of the Poisson distribution at a value hashed from the seed and the id, so the draw is the same
    on every run and needs no coordination; sources meet their targets in expectation. The copies are dealt over all
    partitions by a hash and sorted by it, which gives a random global order whatever the order of the input.

    Rates are one row per source; their table is written first, so Spark knows its size and broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold``, else it splits a large source in a sort-merge join.

    Returns one row per copy: the input's columns, then ``copy`` (from 1), ``n_copies`` and ``shuffle_key``.

    A null source is a source of its own (given weights cannot name it). A null id draws by the hash of its text. Rows that share
    an id draw the same number. Null or empty texts are mixed like others. An empty table gives an empty table.
    """
    rates = written(source_rates(docs, weights, temperature, total, source_col), "source-rates")
    packed = as_row(docs).select("row", field(source_col).alias("of"), F.coalesce(field(id_col).cast("string"), F.md5(field(text_col)), F.lit("")).alias("name"))
    packed = packed.join(rates.select(F.col("source").alias("for"), "pieces", "cdf"), F.col("of").eqNullSafe(F.col("for")))

    def drawn(value: Column) -> Column:
        return F.least(F.size("cdf"), F.size(F.filter("cdf", lambda upto: upto <= value)))

    values = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda piece: unit(F.lit(str(seed)), F.col("name"), piece.cast("string")))
    number = F.aggregate(values, F.lit(0), lambda sum_, value: sum_ + drawn(value))
    copies = packed.select("row", "name", number.alias("number")).where(F.col("number") > 0)
    copies = copies.select("row", "name", "number", F.explode(F.sequence(F.lit(1), F.col("number"))).alias("nth"))
    copies = copies.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), "name", F.col("nth").cast("string"))))
    copies = copies.repartition("place").sortWithinPartitions("place")
    return unpacked(copies, copy=F.col("nth"), n_copies=F.col("number"), shuffle_key=F.col("place"))
