"""Risk matrix, trends, regional performance and revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions import bands, display
from harborline.functions.measures import clamp, count_where, is_late, is_loss, non_zero, percent, zero_if_null
from harborline.functions.months import week_start
from harborline.operators.keep import latest, side_by_side

# Impact of the categories that have no measured impact, and the exposure weights.
IMPACTS = {"Demand Shock": 72.0, "Inventory Stockout": 84.0, "Margin Pressure": 68.0, "Overstock": 54.0}
PROBABILITY_WEIGHT, IMPACT_WEIGHT = 0.55, 0.45


def risk_metrics(delivery: DataFrame, inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """One row of probabilities and impacts in percent."""
    deviation = F.abs(zero_if_null(F.col("stddev_sales_30d"))) / non_zero(F.abs(F.col("avg_sales_30d")))
    over = bands.overstocked(F.col("current_stock"), F.col("reorder_point"))
    return side_by_side(
        delivery.agg(
            percent(is_late()).alias("late_probability"),
            (F.avg(zero_if_null(F.col("late_delivery_rate_by_mode"))) * 100).alias("late_impact"),
            percent(is_loss()).alias("margin_probability"),
        ),
        inventory.agg(
            percent(zero_if_null(F.col("stock_below_reorder")) == 1).alias("stockout_probability"),
            (F.avg(deviation) * 100).alias("demand_volatility"),
            percent(over).alias("overstock_probability"),
        ),
        sales.agg(
            (F.avg(zero_if_null(F.col("avg_defect_rate"))) * 20).alias("supplier_probability"),
            (F.max(zero_if_null(F.col("max_defect_rate"))) * 20).alias("supplier_impact"),
        ),
    )


def exposure(probability: Column, impact: Column) -> Column:
    return clamp(probability * PROBABILITY_WEIGHT + impact * IMPACT_WEIGHT)


def risk_matrix(metrics: DataFrame) -> DataFrame:
    """Six categories with probability, impact and exposure as whole numbers."""
    fixed = lambda category: F.lit(IMPACTS[category])
    measured = lambda name: clamp(F.coalesce(F.col(name), F.lit(0.0)))
    rows = [
        ("Supplier Quality", measured("supplier_probability"), measured("supplier_impact")),
        ("Delivery Delay", measured("late_probability"), measured("late_impact")),
        ("Demand Shock", measured("demand_volatility"), fixed("Demand Shock")),
        ("Inventory Stockout", measured("stockout_probability"), fixed("Inventory Stockout")),
        ("Margin Pressure", measured("margin_probability"), fixed("Margin Pressure")),
        ("Overstock", measured("overstock_probability"), fixed("Overstock")),
    ]
    structs = [
        F.struct(
            F.lit(category).alias("category"),
            display.whole(probability).alias("probability"),
            display.whole(impact).alias("impact"),
            display.whole(exposure(probability, impact)).alias("exposure"),
        )
        for category, probability, impact in rows
    ]
    return metrics.select(F.inline(F.array(*structs)))


def with_exposure_band(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("band", bands.exposure_band(F.col("exposure")))


def risk_summary(matrix: DataFrame) -> DataFrame:
    high = count_where(F.col("exposure") > bands.EXPOSURE_HIGH)
    return matrix.agg(
        high.alias("high_exposure"),
        display.whole(F.avg("exposure")).alias("network_risk"),
        (high + count_where(F.col("probability") > 50)).alias("anomalies"),
        (F.count(F.lit(1)) - high).alias("resolved"),
    )


def risk_trend(delivery: DataFrame, weeks: int = 8) -> DataFrame:
    weekly = (
        delivery.filter(F.col("order_date").isNotNull())
        .groupBy(week_start(F.col("order_date")).alias("week_start"))
        .agg(percent(is_late()).alias("risk"))
    )
    return latest(weekly, "week_start", weeks).withColumn("week", F.date_format("week_start", "MMM d"))


def regional_performance(delivery: DataFrame, n: int = 8) -> DataFrame:
    return (
        delivery.filter(F.col("market").isNotNull())
        .groupBy(F.col("market").alias("region"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            percent(~is_late()).alias("on_time_delivery"),
            F.sum(zero_if_null(F.col("sales"))).cast("double").alias("revenue"),
            F.sum(zero_if_null(F.col("profit"))).cast("double").alias("profit"),
        )
        .orderBy(F.col("orders").desc(), "region")
        .limit(n)
    )


def revenue_trends(sales: DataFrame, months: int = 12) -> DataFrame:
    monthly = (
        sales.filter(F.col("order_date").isNotNull())
        .groupBy(F.trunc("order_date", "month").alias("month_start"))
        .agg(
            F.sum(zero_if_null(F.col("sales"))).cast("double").alias("revenue"),
            F.sum(zero_if_null(F.col("profit"))).cast("double").alias("profit"),
            F.count(F.lit(1)).alias("orders"),
        )
    )
    return latest(monthly, "month_start", months).withColumn("period", F.date_format("month_start", "MMM yyyy"))
