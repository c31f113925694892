"""Small numeric expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(value: Column, over=None) -> Column:
    """Mean as exact sum over count, so decimal input gives the same double in any row order."""
    total, rows = F.sum(value), F.count(value)
    if over is not None:
        total, rows = total.over(over), rows.over(over)
    return F.try_divide(total.cast("double"), rows.cast("double"))


def rate(condition: Column, over=None) -> Column:
    """Share (0..1) of rows for which the condition holds; a NULL condition counts as not holding."""
    share = F.avg(F.when(condition, 1.0).otherwise(0.0))
    return share if over is None else share.over(over)


def percent(condition: Column) -> Column:
    return rate(condition) * 100


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def non_zero(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def is_late(flag: str | Column = "is_late_delivery") -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return zero_if_null(flag) == 1


def is_at_risk() -> Column:
    """Late, and slower than the recent mean of its shipping mode (no mean: never slower)."""
    usual = F.coalesce(F.col("avg_lead_time_by_mode"), F.col("lead_time"), F.lit(0))
    return is_late() & (zero_if_null(F.col("lead_time")) > usual)


def is_loss() -> Column:
    return zero_if_null(F.col("profit")) < 0


def number_or_default(df, name: str, default: float = 0.0) -> Column:
    """The named column as a double, or the default where it is missing, NULL or not a number."""
    if name not in df.columns:
        return F.lit(float(default))
    value = F.col(name).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), float(default)).otherwise(value)
