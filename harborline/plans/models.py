"""Fitted models on the gold tables: delivery delay, anomaly and demand. Weights are trained here, not shipped."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions.measures import clamp
from harborline.operators import isolation

# The inputs of each model.
DELAY_TEXT = ["customer_segment", "shipping_mode", "market", "department", "class"]
DELAY_NUMBERS = [
    "product_id",
    "customer_id",
    "sales",
    "quantity",
    "lead_time",
    "avg_order_value_30d",
    "num_orders_30d",
    "is_high_value",
    "is_bulk_order",
    "day_of_week",
    "month",
    "quarter",
    "year",
]
ANOMALY_NUMBERS = [
    "sales",
    "quantity",
    "profit",
    "lead_time",
    "order_processing_days",
    "avg_order_value_30d",
    "num_orders_30d",
    "avg_lead_time_by_mode",
    "avg_shipping_cost",
    "avg_defect_rate",
    "max_defect_rate",
    "profit_margin",
]
DEMAND_NUMBERS = ["lag_1", "lag_2", "lag_3", "rolling_mean_3", "month"]
# A forest keeps its rows as objects, many times the size of their files: so many rows at most go to one task, about.
ROWS_PER_TASK = 500_000
# Isolation values above one half lie beyond the average path length.
ANOMALY_ABOVE = 0.5


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in names})


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """The rows in enough partitions for ``rows`` in each; as they are where they have as many."""
    parts = -(-df.count() // rows)
    return df if parts <= df.rdd.getNumPartitions() else df.repartition(parts)


def fit_delay(train: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> PipelineModel:
    """Random forest for late delivery on one-hot text features and scaled numbers."""
    codes, flags = [f"{name}_code" for name in DELAY_TEXT], [f"{name}_flags" for name in DELAY_TEXT]
    stages = [
        StringIndexer(inputCols=DELAY_TEXT, outputCols=codes, handleInvalid="keep"),
        OneHotEncoder(inputCols=codes, outputCols=flags, handleInvalid="keep"),
        VectorAssembler(inputCols=DELAY_NUMBERS, outputCol="numbers", handleInvalid="keep"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
        VectorAssembler(inputCols=["scaled", *flags], outputCol="features"),
        RandomForestClassifier(labelCol="is_late_delivery", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(_numbers(spread(train.select(*DELAY_TEXT, *DELAY_NUMBERS, "is_late_delivery")), DELAY_NUMBERS))


def predict_delay(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``delivery_risk``: probability of a late delivery in percent."""
    scored = model.transform(_numbers(rows, DELAY_NUMBERS))
    return scored.withColumn("delivery_risk", vector_to_array("probability")[1] * 100)


def delay_auc(scored: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol="is_late_delivery").evaluate(scored)


def fit_demand(train: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> PipelineModel:
    known = spread(train.dropna(subset=[*DEMAND_NUMBERS, "demand"]))
    stages = [
        VectorAssembler(inputCols=DEMAND_NUMBERS, outputCol="features"),
        RandomForestRegressor(labelCol="demand", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(known)


def predict_demand(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows.dropna(subset=DEMAND_NUMBERS))
    return scored.withColumn("predicted_demand", F.round("prediction", 2))


def demand_rmse(scored: DataFrame) -> float:
    return RegressionEvaluator(labelCol="demand", metricName="rmse").evaluate(scored)


def anomaly_risk(rows: DataFrame, trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """Add anomaly_prediction and anomaly_risk (isolation scaled to 0..100 by its range over all rows)."""
    numbers = _numbers(rows, ANOMALY_NUMBERS)
    moments = numbers.agg(
        *(F.avg(name).alias(f"{name}_mean") for name in ANOMALY_NUMBERS),
        *(F.stddev_samp(name).alias(f"{name}_sd") for name in ANOMALY_NUMBERS),
    ).first()
    scaled = numbers.withColumns(
        {
            f"z_{name}": (F.col(name) - F.lit(moments[f"{name}_mean"])) / F.lit(moments[f"{name}_sd"] or 1.0)
            for name in ANOMALY_NUMBERS
        }
    )
    inputs = [f"z_{name}" for name in ANOMALY_NUMBERS]
    forest = isolation.grow(scaled, inputs, trees, sample, seed).toPandas()  # trees * 2 * sample rows at most
    scored = isolation.score(scaled, inputs, forest, sample).drop(*inputs)
    span = scored.agg(F.min("isolation").alias("low"), F.max("isolation").alias("high")).first()
    width = (span["high"] - span["low"]) or 1.0
    return scored.withColumn("anomaly_risk", clamp((F.col("isolation") - F.lit(span["low"])) / F.lit(width) * 100)).withColumn(
        "anomaly_prediction", F.when(F.col("isolation") > ANOMALY_ABOVE, "Anomaly").otherwise("Normal")
    )
