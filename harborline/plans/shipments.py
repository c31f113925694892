"""Shipment list with risk scores, and live orders beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions import display
from harborline.functions.measures import clamp, count_where, is_late, is_loss, zero_if_null
from harborline.operators.keep import ranked_top

# Points added for a slow lead time and a loss, and the score from which a late order is at risk.
SLOW_POINTS, LOSS_POINTS, AT_RISK_FROM = 15, 10, 70
PROGRESS = {"Delivered": 100, "In Transit": 72}
PROGRESS_OTHERWISE = 46


def risk_score() -> Column:
    """Late share of the mode in percent, plus points for a lead time above the mode's mean and for a loss."""
    lead = zero_if_null(F.col("lead_time"))
    usual = F.coalesce(F.col("avg_lead_time_by_mode"), lead)
    slow = (usual != 0) & (lead > usual)
    return clamp(
        zero_if_null(F.col("late_delivery_rate_by_mode")) * 100
        + F.when(slow, SLOW_POINTS).otherwise(0)
        + F.when(is_loss(), LOSS_POINTS).otherwise(0)
    )


def status(score: Column) -> Column:
    return (
        F.when(is_late() & (score >= AT_RISK_FROM), "At Risk").when(is_late(), "Delayed").otherwise("Delivered")
    )


def scored(delivery: DataFrame) -> DataFrame:
    return delivery.withColumn("risk_score", risk_score()).withColumn("status", status(F.col("risk_score")))


def latest_shipments(delivery: DataFrame, n: int = 100) -> DataFrame:
    """The n latest shipments; order and product id settle equal dates."""
    order = [F.col("shipment_date").desc()] + [
        F.col(name)
        for name in ("order_id", "product_id", "order_date", "avg_lead_time_by_mode", "late_delivery_rate_by_mode")
    ]
    return scored(ranked_top(delivery, order, n, "position")).select(
        "position",
        F.concat(F.lit("ORD-"), "order_id").alias("id"),
        F.coalesce("market", F.lit("Network")).alias("origin"),
        F.coalesce("customer_segment", F.lit("Customer")).alias("destination"),
        F.coalesce("shipping_mode", F.lit("Standard")).alias("carrier"),
        "status",
        F.coalesce(F.col("shipment_date").cast("string"), F.lit("Not scheduled")).alias("eta"),
        F.lit(100).alias("progress"),
        display.whole(F.col("risk_score")).alias("risk_score"),
    )


def live_records(ledger: DataFrame) -> DataFrame:
    """Live orders in the shape of shipment rows."""
    state = F.coalesce("shipment_status", F.lit("In Transit"))
    progress = F.lit(PROGRESS_OTHERWISE)
    for name, value in PROGRESS.items():
        progress = F.when(state == name, value).otherwise(progress)
    return ledger.select(
        F.concat(F.lit("LIVE-"), "event_id").alias("id"),
        F.lit("Live network").alias("origin"),
        F.coalesce(F.col("customer_id").cast("string"), F.lit("Customer")).alias("destination"),
        F.coalesce("shipping_mode", F.lit("Live routing")).alias("carrier"),
        state.alias("status"),
        F.lit("Live now").alias("eta"),
        progress.alias("progress"),
        display.whole(F.col("supply_chain_risk")).alias("risk_score"),
        "ts",
    )


def live_then_history(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live rows newest first, then history rows in their order.

    Order is carried by (part, sort_ts, position) instead of a global row number over the unbounded live rows.
    """
    first = live.withColumn("part", F.lit(0)).withColumnRenamed("ts", "sort_ts")
    return first.unionByName(history.withColumn("part", F.lit(1)), allowMissingColumns=True)


def live_counts(ledger: DataFrame) -> DataFrame:
    """Total, at-risk, delayed and all other live orders."""
    state = F.col("shipment_status")
    at_risk, delayed = count_where(state == "At Risk"), count_where(state == "Delayed")
    total = F.count(F.lit(1))
    return ledger.agg(
        total.alias("total"),
        (total - at_risk - delayed).alias("on_time"),
        delayed.alias("delayed"),
        at_risk.alias("at_risk"),
    )


def with_live(stats: DataFrame, live: DataFrame) -> DataFrame:
    """Historical and live counts added up."""
    names = ["total", "on_time", "delayed", "at_risk"]
    return stats.select(*names).unionByName(live.select(*names)).agg(*(F.sum(name).alias(name) for name in names))
