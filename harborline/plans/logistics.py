"""Monthly logistics mix and shipment volume."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import display
from harborline.functions.measures import count_where, is_at_risk, is_late, is_loss
from harborline.functions.months import month_key, month_label
from harborline.operators.keep import latest

# Slice keys, names, source columns and notes, in display order.
SLICES = [
    ("delivered", "Delivered", "delivered", "Arrived without late-delivery flag"),
    ("inTransit", "In Transit", "in_transit", "Shipment date is still ahead of today"),
    ("delayed", "Delayed", "delayed", "Late-delivery flag from Gold delivery features"),
    ("atRisk", "At Risk", "at_risk", "Late and above shipping-mode lead-time signal"),
    ("returned", "Returned", "returned", "Negative-profit orders used as return/loss proxy"),
]


def dated_rows(history: DataFrame) -> DataFrame:
    """One row per date a history row carries (order_date, date); a row with both counts twice. One scan."""
    dates = F.explode(F.array_compact(F.array("order_date", "date"))).alias("dashboard_date")
    return history.select(
        dates, "is_late_delivery", "shipment_date", "lead_time", "avg_lead_time_by_mode", "profit"
    )


def monthly_logistics(dated: DataFrame, as_of: dt.date) -> DataFrame:
    """Per month the overlapping counts of the logistics mix; "in transit" is relative to ``as_of``."""
    day = F.col("dashboard_date")
    return (
        dated.filter(day.isNotNull())
        .groupBy(F.trunc(day, "month").alias("month_start"))
        .agg(
            count_where(~is_late()).alias("delivered"),
            count_where(F.col("shipment_date") > F.lit(as_of)).alias("in_transit"),
            count_where(is_late()).alias("delayed"),
            count_where(is_at_risk()).alias("at_risk"),
            count_where(is_loss()).alias("returned"),
        )
        .withColumn("id", month_key(F.col("month_start")))
        .withColumn("label", month_label(F.col("month_start")))
    )


def logistics_slices(monthly: DataFrame) -> DataFrame:
    """Five rows per month: key, name, value and note."""
    structs = [
        F.struct(
            F.lit(key).alias("key"), F.lit(name).alias("name"), F.col(source).alias("value"), F.lit(note).alias("note")
        )
        for key, name, source, note in SLICES
    ]
    return monthly.select("id", "month_start", F.inline(F.array(*structs)))


def slice_share(slices: DataFrame) -> DataFrame:
    """Percentage of each slice in the sum of its month's (overlapping) slices."""
    month_total = F.sum("value").over(Window.partitionBy("id"))
    return slices.select("id", "key", "value", F.try_divide(F.col("value") * 100.0, month_total).alias("share_pct"))


def by_month_map(slices: DataFrame) -> DataFrame:
    """One row with a map from month id to its slice array (five slices per month)."""
    months = slices.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("key", "name", "value", "note"))).alias("slices"))
    return months.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "slices")))).alias("by_month"))


def _daily(delivery: DataFrame) -> DataFrame:
    return (
        delivery.filter(F.col("shipment_date").isNotNull())
        .groupBy(F.col("shipment_date").alias("ship_day"))
        .agg(
            count_where(~is_late()).alias("on_time"),
            count_where(is_late()).alias("delayed"),
            count_where(is_at_risk()).alias("at_risk"),
        )
    )


def _weekday(day: Column) -> Column:
    return F.date_format(day, "EEE")


def shipment_volume_daily(delivery: DataFrame, days: int = 7) -> DataFrame:
    return latest(_daily(delivery), "ship_day", days).withColumn("day", _weekday(F.col("ship_day")))


def shipment_volume_weekday(delivery: DataFrame) -> DataFrame:
    """Mean daily counts per weekday, over days that had shipments."""
    return _daily(delivery).groupBy(_weekday(F.col("ship_day")).alias("weekday")).agg(
        F.avg("on_time").alias("on_time"), F.avg("delayed").alias("delayed"), F.avg("at_risk").alias("at_risk")
    )


def weekday_calendar(weekday: DataFrame, as_of: dt.date, live: DataFrame | None = None) -> DataFrame:
    """The seven days up to ``as_of`` with their weekday means (0 where unknown); live counts join the last day."""
    spark = weekday.sparkSession
    last = F.lit(as_of)
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, 6), last)).alias("calendar_day"))
    base = days.withColumn("day", _weekday(F.col("calendar_day"))).join(
        weekday.withColumnRenamed("weekday", "day"), "day", "left"
    )
    names = ["on_time", "delayed", "at_risk"]
    rows = base.select("calendar_day", "day", *(display.whole(F.col(name)).alias(name) for name in names))
    if live is None:
        return rows
    today = live.select(last.alias("calendar_day"), _weekday(last).alias("day"), *names)
    return rows.unionByName(today).groupBy("calendar_day", "day").agg(*(F.sum(name).alias(name) for name in names))
