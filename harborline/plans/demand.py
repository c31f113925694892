"""Weekly demand, smoothed forecast with a confidence band, and the measures derived from them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import bands, display
from harborline.functions.measures import clamp, zero_if_null
from harborline.functions.months import date_column, in_month, week_start
from harborline.operators.keep import latest

# Smoothing weights (this, previous, next week), least band as a share of the forecast, number of
# weeks shown, the demand reference line.
WEIGHTS = (Decimal("0.5"), Decimal("0.3"), Decimal("0.2"))
LEAST_BAND = Decimal("0.08")
WEEKS_SHOWN = 10
CRITICAL_DEMAND = 5400


def weekly_history(history: DataFrame, month_id: str | None = None) -> DataFrame:
    """Units per week of the month's (or all) dated rows."""
    day = date_column(month_id)
    units = F.coalesce("units_sold", "quantity", F.lit(0)).cast("decimal(18,2)")
    return (
        history.filter(F.col(day).isNotNull() & in_month(F.col(day), month_id))
        .groupBy(week_start(F.col(day)).alias("week_start"))
        .agg(F.sum(units).alias("actual"))
    )


def weekly_inventory(inventory: DataFrame) -> DataFrame:
    """Sales, rolling mean and rolling deviation summed per week, latest weeks only."""
    total = lambda name: F.sum(zero_if_null(F.col(name)).cast("double"))
    weekly = (
        inventory.filter(F.col("date").isNotNull())
        .groupBy(week_start(F.col("date")).alias("week_start"))
        .agg(
            F.sum(zero_if_null(F.col("store_sales"))).cast("double").alias("actual"),
            total("avg_sales_30d").alias("forecast"),
            total("stddev_sales_30d").alias("uncertainty"),
        )
    )
    return latest(weekly, "week_start", WEEKS_SHOWN)


def smoothed(weekly: DataFrame) -> DataFrame:
    """Weighted mean of a week and its neighbours; an edge week stands in for its missing neighbour.

    The window has no key because it runs over weekly totals: a few hundred rows however large the facts are.
    """
    in_time = Window.orderBy("week_start")
    previous = F.coalesce(F.lag("actual").over(in_time), F.col("actual"))
    following = F.coalesce(F.lead("actual").over(in_time), F.col("actual"))
    now, before, after = (F.lit(weight) for weight in WEIGHTS)
    return weekly.withColumn("forecast", F.round(now * F.col("actual") + before * previous + after * following))


def with_band(series: DataFrame, spread: str | None = None) -> DataFrame:
    """Add upper and lower: the forecast plus and minus the error (or ``spread``), at least 8 % of the forecast."""
    error = F.abs(F.col("actual") - F.col("forecast")) if spread is None else F.col(spread)
    band = F.greatest(error, F.abs(F.col("forecast")) * F.lit(LEAST_BAND))
    return series.withColumn("upper", F.col("forecast") + band).withColumn(
        "lower", F.greatest(F.lit(0), F.col("forecast") - band)
    )


def as_points(series: DataFrame) -> DataFrame:
    """Chart points: whole numbers, ties to even."""
    whole = [display.whole(F.col(name)).alias(name) for name in ("actual", "forecast", "upper", "lower")]
    return series.select("week_start", F.date_format("week_start", "MMM d").alias("period"), *whole)


def history_points(history: DataFrame, month_id: str | None = None) -> DataFrame:
    return as_points(with_band(latest(smoothed(weekly_history(history, month_id)), "week_start", WEEKS_SHOWN)))


def inventory_points(inventory: DataFrame) -> DataFrame:
    return as_points(with_band(weekly_inventory(inventory), "uncertainty"))


def accuracy(points: DataFrame) -> DataFrame:
    """100 less total absolute error over total actual, in percent, over points with an actual value."""
    used = points.filter(F.coalesce(F.col("actual"), F.lit(0)) != 0)
    missed = F.try_divide(F.sum(F.abs(F.col("forecast") - F.col("actual"))).cast("double"), F.sum("actual"))
    return used.agg(clamp(F.lit(100.0) - F.coalesce(missed * 100, F.lit(0.0))).alias("accuracy"))


def intelligence(points: DataFrame, recent: int) -> DataFrame:
    """One row: accuracy, change of forecast against actual over the ``recent`` last points, risk of the last one."""
    newest = Window.orderBy(F.col("week_start").desc())
    ranked = points.withColumn("back", F.row_number().over(newest))
    used = F.col("actual") != 0
    late = used & (F.col("back") <= recent)
    total = lambda keep, value: F.sum(F.when(keep, value))
    missed = F.try_divide(
        total(used, F.abs(F.col("forecast") - F.col("actual"))).cast("double"), total(used, F.col("actual"))
    )
    change = F.try_divide(
        total(late, F.col("forecast") - F.col("actual")).cast("double"), total(late, F.col("actual"))
    )
    last = lambda name: F.max(F.when(F.col("back") == 1, F.col(name)))
    return ranked.agg(
        clamp(F.lit(100.0) - F.coalesce(missed * 100, F.lit(0.0))).alias("accuracy"),
        clamp(F.coalesce(change * 100, F.lit(0.0)), -100, 100).alias("demand_delta"),
        bands.demand_risk(last("upper"), last("forecast")).alias("demand_risk"),
        F.count(F.lit(1)).alias("points"),
    )


def intelligence_history(history: DataFrame, month_id: str | None = None) -> DataFrame:
    return intelligence(history_points(history, month_id), 3)


def intelligence_inventory(inventory: DataFrame) -> DataFrame:
    return intelligence(inventory_points(inventory), 1)


def monthly_lags(sales: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Monthly units with the three months before and their mean; per key, or for the whole network.

    The window sees one row per key and month; months without a sale between a key's first and last count as 0.
    """
    keys = keys or []
    sold = sales.groupBy(*keys, F.trunc("order_date", "month").alias("month_start")).agg(
        F.sum("quantity").cast("double").alias("demand")
    )
    span = sold.groupBy(*keys).agg(F.min("month_start").alias("first"), F.max("month_start").alias("last"))
    months = F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month_start")
    monthly = span.select(*keys, months).join(sold, [*keys, "month_start"], "left").fillna(0.0, ["demand"])
    in_time = Window.partitionBy(*keys).orderBy("month_start")
    lags = {f"lag_{n}": F.lag("demand", n).over(in_time) for n in (1, 2, 3)}
    return monthly.withColumns(lags).withColumns(
        {
            "rolling_mean_3": (F.col("lag_1") + F.col("lag_2") + F.col("lag_3")) / 3,
            "month": F.month("month_start"),
        }
    )


def live_overlay(points: DataFrame, live: DataFrame) -> DataFrame:
    """History points followed by live forecasts with their 8 % band; live rows have no actual value."""
    base = points.select(
        F.lit(0).alias("part"),
        "period",
        F.col("actual").cast("double").alias("actual"),
        F.col("forecast").cast("double").alias("forecast"),
        F.col("upper").cast("double").alias("upper"),
        F.col("lower").cast("double").alias("lower"),
        (F.col("upper") - F.col("lower")).cast("double").alias("spread"),
    )
    predicted = F.col("predicted_demand")
    added = live.select(
        F.lit(1).alias("part"),
        "period",
        F.lit(None).cast("double").alias("actual"),
        F.col("rolling_mean_3").alias("forecast"),
        (predicted * 1.08).alias("upper"),
        (predicted * 0.92).alias("lower"),
        (predicted * 0.16).alias("spread"),
        predicted.alias("live_demand"),
    )
    return base.unionByName(added, allowMissingColumns=True)


def above_critical(points: DataFrame, limit: float = CRITICAL_DEMAND) -> DataFrame:
    return points.filter(F.col("forecast") > limit)
