"""Threshold rules that turn numbers into labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every threshold below is part of the contract with existing reports.
CRITICAL_SHARE, OVERSTOCK_FACTOR = 0.8, 2
LOW_BELOW, MEDIUM_UP_TO = 25, 60
EXPOSURE_HIGH, EXPOSURE_WARNING = 60, 45
BAND_HIGH, BAND_MEDIUM = 1.25, 1.1


def stock_status(stock: Column, reorder_point: Column) -> Column:
    return (
        F.when(F.coalesce(reorder_point <= 0, F.lit(True)), "Healthy")
        .when(stock < reorder_point * CRITICAL_SHARE, "Critical")
        .when(stock < reorder_point, "Low")
        .when(stock > reorder_point * OVERSTOCK_FACTOR, "Overstock")
        .otherwise("Healthy")
    )


def below_reorder(stock: Column, reorder_point: Column) -> Column:
    return F.coalesce((stock < reorder_point).cast("int"), F.lit(0))


def overstocked(stock: Column, reorder_point: Column) -> Column:
    return (reorder_point > 0) & (stock > reorder_point * OVERSTOCK_FACTOR)


def risk_category(score: Column) -> Column:
    return (
        F.when(score.isNull(), "Unknown")
        .when(score < LOW_BELOW, "Low")
        .when(score <= MEDIUM_UP_TO, "Medium")
        .otherwise("High")
    )


def exposure_band(exposure: Column) -> Column:
    return F.when(exposure > EXPOSURE_HIGH, "high").when(exposure > EXPOSURE_WARNING, "warning").otherwise("normal")


def grade(value: Column, high: float, medium: float, inclusive: bool = False) -> Column:
    """High/Medium/Low by two thresholds; ``inclusive`` makes each threshold part of its band."""
    above = (lambda limit: value >= limit) if inclusive else (lambda limit: value > limit)
    return F.when(above(high), "High").when(above(medium), "Medium").otherwise("Low")


def demand_risk(upper: Column, forecast: Column) -> Column:
    return F.when(upper > forecast * BAND_HIGH, "High").when(upper > forecast * BAND_MEDIUM, "Medium").otherwise("Low")
