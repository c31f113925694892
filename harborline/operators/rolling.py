"""Moving aggregates over the last n rows of a key, safe for keys that hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HEAVY_ROWS = 20_000_000
ROWS_PER_BLOCK = 1_000_000
NO_DAY = -(1 << 40)  # sorts before every day, like a NULL date
_DAY, _SLICE = "_block_day", "_block_slice"


@dataclass(frozen=True)
class ExactMean:
    """Mean of a column of whole numbers or decimals, whose sums are exact.

    It is taken from running sums and counts and those ``rows`` rows before, so a row costs the same for any length of the
    frame; Spark adds up the whole frame of a moving aggregate for every row.
    """

    column: str


@dataclass(frozen=True)
class RowCount:
    """Number of rows in the frame."""


def _with_measures(df: DataFrame, keys: list[str], order: list[str], rows: int, measures: dict) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(*order)
    frame, so_far = along.rowsBetween(1 - rows, 0), along.rowsBetween(Window.unboundedPreceding, 0)
    first, before, last = {}, {}, {}
    for name, measure in measures.items():
        if isinstance(measure, RowCount):
            last[name] = F.least(F.col(f"_at_{name}"), F.lit(rows)).cast("bigint")
            first[f"_at_{name}"] = F.row_number().over(along)
        elif isinstance(measure, ExactMean):
            parts = {f"_sum_{name}": F.sum(measure.column), f"_count_{name}": F.count(measure.column)}
            first |= {part: total.over(so_far) for part, total in parts.items()}
            before |= {f"{part}_before": F.lag(part, rows).over(along) for part in parts}
            total, n = ((F.col(part) - F.coalesce(f"{part}_before", F.lit(0))).cast("double") for part in parts)
            last[name] = F.try_divide(total, n)
        else:
            first[name] = measure(frame)
    added = df.withColumns(first).withColumns(before) if before else df.withColumns(first)
    return added.select(*df.columns, *(last.get(name, F.col(name)).alias(name) for name in measures))


def heavy_keys(df: DataFrame, keys: list[str], min_rows: int = HEAVY_ROWS) -> DataFrame:
    """All keys with at least ``min_rows`` rows.

    The table only decides which keys are cut into blocks; results are the same either way. It has at most
    rows / ``min_rows`` entries.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.filter(F.col("_rows") >= min_rows).select(*keys)


def day_slices(df: DataFrame, day: str, number: str, rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row per day (day, low, high, parts, days): how to cut rows into blocks of about ``rows``.

    A busy day is cut into ``parts`` ranges of ``number`` between that day's own low and high, so numbers that ascend with
    the date are cut as well; if all days are quiet, they are taken ``days`` at a time. It only steers how rows are
    spread, so a cheaper frame with about the same rows will do. It has one row per date: write it once, and Spark knows
    its size when it chooses the join.
    """
    per_day = df.groupBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(number).alias("low"), F.max(number).alias("high")
    )
    busiest = per_day.select(F.max("rows")).scalar()
    return per_day.select(
        "day",
        "low",
        "high",
        F.ceil(F.col("rows") / rows).cast("bigint").alias("parts"),
        F.greatest(F.lit(1), F.floor(F.lit(rows) / busiest)).cast("bigint").alias("days"),
    )


def rolling(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rows: int,
    measures: dict[str, Callable[[WindowSpec], Column] | ExactMean | RowCount],
    inputs: list[str],
    heavy: DataFrame | str | None = None,
    slices: DataFrame | None = None,
    copies_from: DataFrame | None = None,
    gather: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Add ``measures`` over the last ``rows`` rows (current included) of each key in the given order.

    ``order`` is a date followed by columns that make the order unique, the first of them a whole number;
    ``inputs`` are the columns the measures read. ``heavy`` names keys that are too large for one task: a frame
    of keys, or ``"all"`` when the key itself has few values.

    A heavy key is cut into blocks by day; with ``slices`` (see ``day_slices``) by several days or, within a day, by
    ranges of the first tie-breaking number among those of the day. Blocks follow the sort order.
    Each block is a window partition of its own and starts with copies of the ``rows - 1`` rows before it, which
    are dropped afterwards. Copies come from the last ``rows - 1`` rows of earlier blocks only. They are taken from
    ``copies_from`` when given: the same rows before other columns were added, which is cheaper to read again.
    ``gather`` deals rows and copies to tasks by the columns of a block, both in the same way, in place of a shuffle.
    """
    if heavy is None:
        return _with_measures(df, keys, order, rows, measures)

    def blocked(rows_in: DataFrame) -> DataFrame:
        names = rows_in.columns
        day = F.datediff(F.col(order[0]), F.lit("1970-01-01").cast("date"))
        number = F.lit(0).cast("bigint")
        if slices is not None:
            cuts = slices.select(*(F.col(name).alias(f"_cut_{name}") for name in ("day", "low", "high", "parts")))
            rows_in = rows_in.join(cuts, day.eqNullSafe(F.col("_cut_day")), "left")
            # equal ranges of the day's numbers, in their order; NULL sorts first and gets the lowest slice
            bucket = F.width_bucket(F.col(order[1]), F.col("_cut_low"), F.col("_cut_high") + 1, F.col("_cut_parts"))
            number = F.coalesce(F.when(F.col("_cut_parts") > 1, bucket).otherwise(0), F.lit(-1)).cast("bigint")
            day = F.floor(day / slices.select(F.max("days")).scalar())
        day = F.coalesce(day, F.lit(NO_DAY)).cast("bigint")
        if isinstance(heavy, str):
            return rows_in.select(*names, day.alias(_DAY), number.alias(_SLICE))
        marks = heavy.select(*keys, F.lit(True).alias("_heavy"))
        labels = [F.when(F.col("_heavy"), value).alias(name) for value, name in ((day, _DAY), (number, _SLICE))]
        return rows_in.join(marks, keys, "left").select(*names, *labels)

    block = [*keys, _DAY, _SLICE]
    needed = list(dict.fromkeys([*keys, *order, *inputs]))
    source = blocked((df if copies_from is None else copies_from).select(*needed))
    copies = _rows_before_blocks(source.filter(F.col(_DAY).isNotNull()), keys, order, rows)
    originals, copies = blocked(df).withColumn("_copy", F.lit(False)), copies.withColumn("_copy", F.lit(True))
    if gather is not None:
        originals, copies = gather(originals, block), gather(copies, block)
    added = _with_measures(originals.unionByName(copies, allowMissingColumns=True), block, order, rows, measures)
    return added.filter(~F.col("_copy")).drop("_copy", _DAY, _SLICE)


def _rows_before_blocks(rows_in: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """For every block, the ``rows - 1`` rows of its key that come before it, labelled with that block."""
    block = [*keys, _DAY, _SLICE]
    along = Window.partitionBy(*keys).orderBy(_DAY, _SLICE)
    following = along.rowsBetween(1, rows - 1)
    sizes = (
        rows_in.groupBy(*block)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_end", F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_size"))
        .withColumn("_next", F.collect_list(F.struct(_DAY, _SLICE, "_start")).over(following))
        .select(*(F.col(name).alias(f"_of_{name}") for name in block), "_end", "_next")
    )
    newest_first = Window.partitionBy(*block).orderBy(*(F.col(name).desc() for name in order))
    tails = rows_in.withColumn("_back", F.row_number().over(newest_first)).filter(F.col("_back") <= rows - 1)
    same_block = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in keys]
    same_block += [F.col(name) == F.col(f"_of_{name}") for name in (_DAY, _SLICE)]
    reach = F.col("_end") - F.col("_back") + (rows - 1)
    targets = F.filter("_next", lambda later: later["_start"] <= reach)
    return (
        tails.join(sizes, same_block)
        .withColumn("_target", F.explode(targets))
        .withColumn(_DAY, F.col(f"_target.{_DAY}"))
        .withColumn(_SLICE, F.col(f"_target.{_SLICE}"))
        .select(*rows_in.columns)
    )
