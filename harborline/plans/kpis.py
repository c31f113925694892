"""Headline figures: delivery, inventory and cost KPIs, activity feed, insights, utilisation, shipment counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions import bands, display
from harborline.functions.measures import (
    clamp,
    count_where,
    is_at_risk,
    is_late,
    is_loss,
    mean,
    non_zero,
    number_or_default,
    percent,
    rate,
    zero_if_null,
)
from harborline.functions.months import date_column, in_month
from harborline.operators.keep import ranked_top, side_by_side


def _below(name: str = "stock_below_reorder") -> Column:
    return zero_if_null(F.col(name)) == 1


def _accuracy(actual: str, expected: str) -> Column:
    """100 less the mean relative error in percent; the error is at most 100 and rows without actuals do not count."""
    true, guess = F.col(actual).cast("double"), F.col(expected).cast("double")
    error = F.abs(zero_if_null(true) - zero_if_null(guess)) / non_zero(F.abs(true))
    return F.lit(100.0) - F.least(F.lit(100.0), F.avg(error) * 100)


def delivery_kpis(delivery: DataFrame) -> DataFrame:
    return delivery.agg(
        F.count(F.lit(1)).alias("shipments"),
        count_where(is_late()).alias("late_shipments"),
        percent(~is_late()).alias("on_time_pct"),
    )


def inventory_kpis(inventory: DataFrame) -> DataFrame:
    stock = mean(non_zero(F.col("current_stock")))
    return inventory.agg(
        count_where(_below()).alias("reorder_alerts"),
        F.try_divide(F.sum(zero_if_null(F.col("store_sales"))).cast("double"), non_zero(stock)).alias("inventory_turns"),
        _accuracy("store_sales", "avg_sales_30d").alias("forecast_accuracy"),
    )


def cost_kpis(sales: DataFrame) -> DataFrame:
    return sales.agg(F.avg(zero_if_null(F.col("avg_shipping_cost"))).alias("cost_per_order"))


def kpi_row(delivery: DataFrame, inventory: DataFrame, sales: DataFrame) -> DataFrame:
    return side_by_side(delivery_kpis(delivery), inventory_kpis(inventory), cost_kpis(sales))


def kpi_metrics(delivery: DataFrame, inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """Six KPI rows (id, label, value, hint)."""
    late = display.grouped(F.col("late_shipments"))
    rows = [
        ("k1", "On-Time Delivery", F.col("on_time_pct"), F.lit("Gold delivery features")),
        ("k2", "Forecast Accuracy", clamp(F.col("forecast_accuracy")), F.lit("Gold inventory features")),
        ("k3", "Inventory Turns", F.col("inventory_turns"), F.lit("sales vs. stock")),
        ("k4", "Shipments", F.col("shipments"), F.concat(late, F.lit(" late"))),
        ("k5", "Cost / Order", F.col("cost_per_order"), F.lit("avg shipping cost")),
        ("k6", "Open Exceptions", F.col("reorder_alerts") + F.col("late_shipments"), F.lit("late + reorder alerts")),
    ]
    return _tidy(kpi_row(delivery, inventory, sales), rows)


def _tidy(one_row: DataFrame, rows: list[tuple[str, str, Column, Column]]) -> DataFrame:
    structs = [
        F.struct(
            F.lit(key).alias("id"),
            F.lit(label).alias("label"),
            F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"),
            hint.alias("hint"),
        )
        for key, label, value, hint in rows
    ]
    return one_row.select(F.inline(F.array(*structs)))


def historical_summary(history: DataFrame, month_id: str | None = None) -> DataFrame:
    """One row of delivery, accuracy, cost and loss figures for a month, or for all dated rows."""
    day = date_column(month_id)
    scoped = history.filter(F.col(day).isNotNull() & in_month(F.col(day), month_id))
    return scoped.agg(
        F.count(F.lit(1)).alias("shipments"),
        count_where(is_late()).alias("late_shipments"),
        percent(~is_late()).alias("on_time_pct"),
        _accuracy("sales", "avg_order_value_30d").alias("forecast_accuracy"),
        F.avg(zero_if_null(F.col("avg_shipping_cost"))).alias("cost_per_order"),
        count_where(is_loss()).alias("loss_orders"),
        F.max(day).alias("latest_order_date"),
    )


def frame_summary(frame: DataFrame) -> DataFrame:
    """Variant of the summary in which rows with zero sales count as no error and absent columns as zero."""
    sales, usual = number_or_default(frame, "sales"), number_or_default(frame, "avg_order_value_30d")
    error = F.coalesce(F.abs(sales - usual) / non_zero(F.abs(sales)), F.lit(0.0))
    late = number_or_default(frame, "is_late_delivery") == 1
    return frame.agg(
        F.count(F.lit(1)).alias("shipments"),
        count_where(late).alias("late_shipments"),
        percent(~late).alias("on_time_pct"),
        clamp(F.lit(100.0) - F.avg(error) * 100).alias("forecast_accuracy"),
        F.avg(number_or_default(frame, "avg_shipping_cost")).alias("cost_per_order"),
        count_where(number_or_default(frame, "profit") < 0).alias("loss_orders"),
        F.max("order_date").alias("latest_order_date"),
    )


def by_mode(delivery: DataFrame) -> DataFrame:
    mode = F.coalesce("shipping_mode", F.lit("Unknown mode")).alias("mode")
    return delivery.groupBy(mode).agg(F.count(F.lit(1)).alias("orders"), percent(is_late()).alias("late_pct"))


def late_by_mode(delivery: DataFrame, n: int = 4) -> DataFrame:
    return by_mode(delivery).orderBy(F.col("late_pct").desc(), "mode").limit(n)


def riskiest_mode(delivery: DataFrame) -> DataFrame:
    return late_by_mode(delivery, 1).select(F.col("mode").alias("shipping_mode"), "late_pct")


def _mode_sentence(orders: Column) -> Column:
    return F.concat(
        "mode", F.lit(" late-delivery rate is "), display.fixed(F.col("late_pct"), 1), F.lit("% across "), orders,
        F.lit(" orders"),
    )


def historical_activity_feed(history: DataFrame) -> DataFrame:
    """Sentences for the four modes with the highest late share."""
    top = ranked_top(by_mode(history), [F.col("late_pct").desc(), F.col("mode")], 4)
    return top.select(
        F.concat(F.lit("a"), "rank").alias("id"),
        F.lit("Logistics").alias("agent"),
        _mode_sentence(display.grouped(F.col("orders"))).alias("action"),
        F.when(F.col("late_pct") > 25, "warning").otherwise("success").alias("status"),
    )


def activity_feed(delivery: DataFrame, inventory: DataFrame, n: int = 6) -> DataFrame:
    """One sentence per shipping mode and one about stock, highest score first.

    The stock score is a row count while mode scores are shares, so a non-zero stock row sorts first.
    """
    modes = by_mode(delivery).select(
        F.lit("Logistics").alias("agent"),
        _mode_sentence(F.col("orders").cast("string")).alias("action"),
        F.when(F.col("late_pct") > 25, "warning").otherwise("success").alias("status"),
        (F.col("late_pct") / 100).alias("sort_score"),
    )
    alerts = inventory.agg(count_where(_below()).alias("alerts")).select(
        F.lit("Inventory").alias("agent"),
        F.concat("alerts", F.lit(" product-store pairs are below reorder point")).alias("action"),
        F.when(F.col("alerts") > 0, "warning").otherwise("success").alias("status"),
        F.col("alerts").cast("double").alias("sort_score"),
    )
    ranked = ranked_top(modes.unionByName(alerts), [F.col("sort_score").desc(), F.col("action")], n)
    return ranked.select(F.concat(F.lit("a"), "rank").alias("id"), "agent", "action", "status")


def insight_metrics(delivery: DataFrame, inventory: DataFrame, sales: DataFrame) -> DataFrame:
    stock, point = F.col("current_stock"), F.col("reorder_point")
    return side_by_side(
        delivery.agg(percent(is_late()).alias("late_pct")),
        inventory.agg(
            count_where(_below()).alias("below_reorder"),
            count_where(bands.overstocked(stock, point)).alias("overstocked"),
        ),
        sales.agg(
            F.avg(zero_if_null(F.col("avg_defect_rate"))).alias("avg_defect_rate"),
            F.max(zero_if_null(F.col("max_defect_rate"))).alias("max_defect_rate"),
        ),
    )


def insight_severity(metrics: DataFrame, riskiest: DataFrame) -> DataFrame:
    """Four insight rows (id, title, summary, value, impact, confidence, category) from the insight metrics and the riskiest mode."""
    late, mode_late = F.col("late_pct"), F.coalesce("mode_late_pct", F.lit(0.0))
    mode = riskiest.select("shipping_mode", F.col("late_pct").alias("mode_late_pct"))
    defect = clamp(F.col("max_defect_rate") * 20)
    confidence = display.whole(clamp(F.lit(100.0) - late / 2, 55, 96))
    # fixed values: the sentences that readers of the insights know
    summaries = {
        "i1": [F.coalesce("shipping_mode", F.lit("Primary")), " shipping has the highest late-delivery signal at ", display.fixed(mode_late, 1), "%."],
        "i2": [display.grouped(F.col("below_reorder")), " product-store pairs are below reorder point in the Gold inventory features."],
        "i3": [display.grouped(F.col("overstocked")), " product-store pairs are above twice their reorder point."],
        "i4": ["Maximum defect signal maps to a ", display.whole(defect).cast("string"), "/100 quality-risk score."],
    }
    rows = [
        ("i1", "Delivery pressure", late, bands.grade(late, 30, 15, True), confidence, "Logistics"),
        ("i2", "Reorder exposure", F.col("below_reorder"), bands.grade(F.col("below_reorder"), 50, 0), 88, "Inventory"),
        (
            "i3",
            "Working capital watch",
            F.col("overstocked"),
            F.when(F.col("overstocked") > 0, "Medium").otherwise("Low"),
            82,
            "Inventory",
        ),
        ("i4", "Supplier quality signal", defect, bands.grade(defect, 70, 40), 79, "Risk"),
    ]
    structs = [
        F.struct(
            F.lit(key).alias("id"),
            F.lit(title).alias("title"),
            F.concat(*(F.lit(part) if isinstance(part, str) else part for part in summaries[key])).alias("summary"),
            value.cast("double").alias("value"),
            impact.alias("impact"),
            (F.lit(sure) if isinstance(sure, int) else sure).cast("bigint").alias("confidence"),
            F.lit(category).alias("category"),
        )
        for key, title, value, impact, sure, category in rows
    ]
    return side_by_side(metrics, mode).select(F.inline(F.array(*structs)))


def historical_insights(summary: DataFrame) -> DataFrame:
    """Delivery and margin insight rows from a historical summary."""
    late, losses = F.col("late_shipments"), F.col("loss_orders")
    rows = [
        ("i1", "Historical delivery pressure", F.col("on_time_pct"), bands.grade(late, 1000, 0), "Logistics"),
        ("i2", "Margin pressure", losses, bands.grade(losses, 50, 0), "Demand"),
    ]
    structs = [
        F.struct(
            F.lit(key).alias("id"),
            F.lit(title).alias("title"),
            value.cast("double").alias("value"),
            impact.alias("impact"),
            F.lit(category).alias("category"),
        )
        for key, title, value, impact, category in rows
    ]
    return summary.select(F.inline(F.array(*structs)))


def replenishment_candidates(inventory: DataFrame, n: int = 4) -> DataFrame:
    """The lowest stocks below their reorder point; one "no action" row when there are none."""
    order = [F.col("current_stock"), F.col("reorder_point").desc(), F.col("product_id"), F.col("store_id"), F.col("date")]
    low = ranked_top(inventory.filter(_below()), order, n).select(
        F.concat(F.lit("d"), "rank").alias("id"),
        F.concat(F.lit("Review replenishment for "), F.col("product_id").cast("string")).alias("title"),
        F.concat(
            F.col("store_id").cast("string"),
            F.lit(" has "),
            display.grouped(F.col("current_stock")),
            F.lit(" units against a reorder point of "),
            display.grouped(F.col("reorder_point")),
            F.lit("."),
        ).alias("description"),
        F.lit("review").alias("status"),
    )
    # fixed values: what stands in an empty list
    nothing = inventory.sparkSession.sql(
        "SELECT 'd1' AS id, 'No replenishment action' AS title, "
        "'Gold inventory features show no product-store pairs below reorder point.' AS description, 'executed' AS status"
    )
    both = low.withColumn("part", F.lit(0)).unionByName(nothing.withColumn("part", F.lit(1)))
    # the window sees at most n + 1 rows
    first = F.min("part").over(Window.partitionBy())
    return both.withColumn("first", first).filter("part = first").drop("part", "first")


def warehouse_utilisation(inventory: DataFrame, n: int = 8) -> DataFrame:
    """The stores with the most stock and how full they are against stock plus reorder points."""
    stock, point = zero_if_null(F.col("current_stock")), zero_if_null(F.col("reorder_point"))
    stores = inventory.groupBy("store_id").agg(
        F.sum(stock).alias("stock"), F.sum(stock + point).alias("capacity_proxy")
    )
    capacity = F.greatest("capacity_proxy", "stock", F.lit(1).cast("bigint"))
    return ranked_top(stores, [F.col("stock").desc(), F.col("store_id")], n).select(
        F.concat(F.lit("w"), "rank").alias("id"),
        F.col("store_id").cast("string").alias("name"),
        display.whole(clamp(F.col("stock") / capacity * 100)).alias("utilisation"),
        capacity.alias("capacity"),
    )


def shipment_stats(delivery: DataFrame) -> DataFrame:
    return delivery.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(~is_late()).alias("on_time"),
        count_where(is_late()).alias("delayed"),
        count_where(is_at_risk()).alias("at_risk"),
    )


def dashboard_summary(delivery: DataFrame, inventory: DataFrame, sales: DataFrame) -> dict[str, DataFrame]:
    """The six parts of the overview, each its own small frame."""
    return {
        "kpi_metrics": kpi_metrics(delivery, inventory, sales),
        "activity_feed": activity_feed(delivery, inventory),
        "insights": insight_severity(insight_metrics(delivery, inventory, sales), riskiest_mode(delivery)),
        "replenishment": replenishment_candidates(inventory),
        "utilisation": warehouse_utilisation(inventory),
        "shipment_stats": shipment_stats(delivery),
    }


def as_payload(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, payload): each part as one JSON array. Parts are top-n reports of a few rows."""
    payloads = [
        frame.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*frame.columns)))).alias("payload")).select(
            F.lit(name).alias("part"), "payload"
        )
        for name, frame in parts.items()
    ]
    result = payloads[0]
    for payload in payloads[1:]:
        result = result.unionByName(payload)
    return result
