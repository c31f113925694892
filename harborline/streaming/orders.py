"""Order stream: scoring, ledger, live measures, windowed counts and mart refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions.measures import clamp, count_where, percent
from harborline.plans.demand import LEAST_BAND
from harborline.plans.scoring import forecast_demand, keep_failed, score_risk, two_digits
from harborline.session import fresh_path

# Shipment states, how many demand points are kept and shown, how often marts are refreshed.
STATES = ("Delivered", "In Transit", "Delayed", "At Risk", "Returned")
UNKNOWN_STATE = "In Transit"
POINTS_KEPT, POINTS_SHOWN, REFRESH = 30, 10, "30 seconds"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def score_orders(orders: DataFrame) -> DataFrame:
    """Risk scores per arriving order; an order that cannot be scored is kept with category Unknown."""
    return keep_failed(score_risk(orders))


def demand_events(lags: DataFrame) -> DataFrame:
    """Forecast and three-month mean per arriving lag record."""
    mean = (F.col("lag_1") + F.col("lag_2") + F.col("lag_3")) / 3
    return forecast_demand(lags).withColumn("rolling_mean_3", two_digits(mean))


def as_pipeline_event(orders: DataFrame) -> DataFrame:
    """Each scored order as the nested JSON event that consumers read."""
    summary = F.struct("sales", "shipping_mode", "lead_time", F.col("avg_defect_rate").alias("defect_rate"))
    risk = F.struct(
        summary.alias("order_summary"), "shipment_status", "delivery_risk", "anomaly_risk", "supply_chain_risk", "risk_category"
    )
    event = F.struct(F.lit("pipeline_tick").alias("type"), F.col("ts").alias("timestamp"), risk.alias("risk"))
    return orders.select("event_id", F.to_json(event).alias("event"))


def status_counts(orders: DataFrame) -> DataFrame:
    """Orders per shipment state; an unknown state counts as in transit."""
    state = F.when(F.col("shipment_status").isin(*STATES), F.col("shipment_status")).otherwise(UNKNOWN_STATE)
    return orders.groupBy(state.alias("shipment_status")).agg(F.count(F.lit(1)).alias("orders"))


def mode_late_rate(orders: DataFrame) -> DataFrame:
    late = F.col("shipment_status").isin("Delayed", "At Risk")
    mode = F.coalesce("shipping_mode", F.lit("Unknown mode")).alias("mode")
    return orders.groupBy(mode).agg(F.count(F.lit(1)).alias("orders"), count_where(late).alias("late"))


def worst_modes(rates: DataFrame, n: int = 4) -> DataFrame:
    share = F.col("late") / F.greatest(F.col("orders"), F.lit(1)) * 100
    return rates.withColumn("late_pct", share).orderBy(F.col("late_pct").desc(), "mode").limit(n)


def tumbling_status(
    orders: DataFrame, length: str = "1 hour", slide: str | None = None, late_by: str = "10 minutes"
) -> DataFrame:
    """Orders per state and event-time window. The watermark bounds the state kept for open windows."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        orders.withWatermark("ts", late_by)
        .groupBy(span.alias("span"), "shipment_status")
        .agg(F.count(F.lit(1)).alias("orders"))
        .select(F.col("span.start").alias("window_start"), "shipment_status", "orders")
    )


def without_replays(orders: DataFrame, late_by: str = "10 minutes") -> DataFrame:
    """Each event once, within the watermark, so replayed files do not count twice."""
    return orders.withWatermark("ts", late_by).dropDuplicatesWithinWatermark(["event_id"])


def drain_to_files(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run an append stream over all available input into Parquet and return what was written.

    A job that is started again with the same ``path`` goes on where it stopped; without one, it is a new job.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_latest(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run an aggregating stream over all available input and return the last result.

    Every batch writes the whole result into its own folder, so a reader never sees half of one. A job that is started
    again with the same ``path`` goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(replace)
        .option("checkpointLocation", f"{path}-state")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    results = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return results.filter(F.col("batch") == results.select(F.max("batch")).scalar()).drop("batch")


def last_points(ledger: DataFrame, n: int = POINTS_KEPT) -> DataFrame:
    """The n newest rows of the ledger."""
    return ledger.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def live_summary(ledger: DataFrame) -> DataFrame:
    """Order counts, on-time and late percentages of the ledger."""
    state = F.col("shipment_status")
    return ledger.agg(
        F.count(F.lit(1)).alias("total"),
        percent(state == "Delivered").alias("on_time_pct"),
        percent(state.isin("Delayed", "At Risk")).alias("late_pct"),
        count_where(state == "Returned").alias("returned"),
    )


def live_accuracy(points: DataFrame) -> DataFrame:
    """100 less the error of the shown demand points against their three-month mean, in percent."""
    missed = F.sum(F.abs(F.col("predicted_demand") - F.col("rolling_mean_3")))
    actual = F.sum("rolling_mean_3")
    share = F.coalesce(missed / F.when(actual == 0, F.lit(1.0)).otherwise(actual), F.lit(0.0))
    return points.agg(clamp(F.lit(100.0) - share * 100).alias("accuracy"))


def live_demand_series(points: DataFrame) -> DataFrame:
    """The shown demand points as actual, forecast and band."""
    series = points.withColumn("actual", F.bround("rolling_mean_3").cast("decimal(18,2)")).withColumn(
        "forecast", F.bround("predicted_demand").cast("decimal(18,2)")
    )
    least = F.bround(F.abs(F.col("forecast")) * F.lit(LEAST_BAND))  # a whole number, ties to even
    band = F.greatest(F.abs(F.col("actual") - F.col("forecast")), least)
    series = series.withColumn("upper", F.col("forecast") + band).withColumn("lower", F.greatest(F.lit(0), F.col("forecast") - band))
    columns = [F.col(name).cast("double").alias(name) for name in ("actual", "forecast", "upper", "lower")]
    return series.select("period", *columns)
