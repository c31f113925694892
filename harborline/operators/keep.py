"""First row per key, latest periods, one-row combinations and scope fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column], ties: list[str] | None = None) -> DataFrame:
    """One row per key: the first in the given order, remaining columns breaking ties.

    The rank filter lets Spark keep one row per key in every map task before the shuffle, so a key that holds a
    third of all rows arrives as one row per task.
    """
    rest = [name for name in (ties if ties is not None else df.columns) if name not in keys]
    ranked = Window.partitionBy(*keys).orderBy(*order, *(F.col(name).desc_nulls_last() for name in rest))
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def keep_greatest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The rows that ``keep_first`` keeps for descending orders with nulls last, as an aggregate of structs.

    For readers of a few columns: if no column beside the keys is read, as in a count, Spark drops the structs, so that
    rows are neither widened nor sorted and only keys are shuffled. A reader of any other column pays for all of them.
    """
    rest = [name for name in df.columns if name not in keys and name not in by]
    found = df.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("_first"))
    return found.select(*(F.col(name) if name in keys else F.col("_first")[name].alias(name) for name in df.columns))


def latest(df: DataFrame, period: str, n: int) -> DataFrame:
    """The n latest periods of an aggregate, oldest first."""
    return df.orderBy(F.col(period).desc()).limit(n).orderBy(period)


def ranked_top(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows and their position; the window runs over those n rows only."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Several one-row frames as one row, without joining them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*(F.max(name).alias(name) for name in stacked.columns))


def scoped_or_all(df: DataFrame, in_scope: Column) -> DataFrame:
    """Rows in scope; every row when none is. The emptiness test is an uncorrelated scalar subquery."""
    hits = df.filter(in_scope).limit(1).agg(F.count(F.lit(1)).alias("n"))
    return df.filter(in_scope | (hits.scalar() == 0))
