"""Closed-form risk and demand scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.bands import risk_category
from harborline.functions.measures import clamp

# Defaults of absent inputs and the constants of both formulas.
DEFAULTS = {"lead_time": 5.0, "avg_lead_time_by_mode": 5.0, "avg_defect_rate": 1.0, "sales": 100.0}
BASE, PER_DELAY_DAY, PER_THOUSAND_SALES, DELIVERY_RANGE = 15.0, 12.0, 5.0, (5.0, 95.0)
DEFECT_LIMIT, DELAY_LIMIT, ANOMALY_SCORE, NORMAL_SCORE = 4.5, 6.0, -0.15, 0.25
PER_DEFECT, PER_ANOMALY_DAY, ANOMALY_RANGE = 12.0, 8.0, (2.0, 98.0)
DELIVERY_WEIGHT, ANOMALY_WEIGHT = 0.60, 0.40
TREND_WEIGHT, LEAST_DEMAND = 0.15, 10.0
SCORES = ["delivery_risk", "anomaly_prediction", "anomaly_score", "anomaly_risk", "supply_chain_risk", "risk_category"]


def _input(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(DEFAULTS[name])


def two_digits(value: Column) -> Column:
    return F.round(value.cast("decimal(28,8)"), 2).cast("double")


def composite(delivery: Column, anomaly: Column) -> Column:
    return delivery * DELIVERY_WEIGHT + anomaly * ANOMALY_WEIGHT


def score_risk(df: DataFrame) -> DataFrame:
    """Add delivery, anomaly and composite risk. An absent column takes its default; a NULL gives NULL scores."""
    inputs = {name: _input(df, name) for name in DEFAULTS}
    lead, usual, defect, sales = (
        inputs[name] for name in ("lead_time", "avg_lead_time_by_mode", "avg_defect_rate", "sales")
    )
    complete = lead.isNotNull() & usual.isNotNull() & defect.isNotNull() & sales.isNotNull()
    # least/greatest skip NULLs, so a row with an unknown input is masked as a whole
    known = lambda value: F.when(complete, value)
    delay = F.greatest(F.lit(0.0), lead - usual)
    delivery = clamp(BASE + delay * PER_DELAY_DAY + (sales / 1000.0) * PER_THOUSAND_SALES, *DELIVERY_RANGE)
    anomaly = clamp(defect * PER_DEFECT + delay * PER_ANOMALY_DAY, *ANOMALY_RANGE)
    unusual = (defect > DEFECT_LIMIT) | (delay > DELAY_LIMIT)
    total = known(composite(delivery, anomaly))
    return df.withColumns(
        {
            "delivery_risk": two_digits(known(delivery)),
            "anomaly_prediction": known(F.when(unusual, "Anomaly").otherwise("Normal")),
            "anomaly_score": known(F.when(unusual, ANOMALY_SCORE).otherwise(NORMAL_SCORE)),
            "anomaly_risk": two_digits(known(anomaly)),
            "supply_chain_risk": two_digits(total),
            "risk_category": risk_category(total),
        }
    )


def keep_failed(scored: DataFrame) -> DataFrame:
    """Orders that could not be scored stay, with zero scores, an error mark and an unknown category."""
    zeros = {
        name: F.coalesce(F.col(name), F.lit(0.0))
        for name in ("delivery_risk", "anomaly_score", "anomaly_risk", "supply_chain_risk")
    }
    return scored.withColumns({**zeros, "anomaly_prediction": F.coalesce("anomaly_prediction", F.lit("Error"))})


def composite_risk(df: DataFrame) -> DataFrame:
    """Composite and category from given delivery_risk and anomaly_risk columns."""
    total = composite(F.col("delivery_risk"), F.col("anomaly_risk"))
    return df.withColumn("supply_chain_risk", two_digits(total)).withColumn("risk_category", risk_category(total))


def forecast_demand(df: DataFrame) -> DataFrame:
    """Next demand from lag_1..lag_3: their mean plus part of the trend, at least 10."""
    complete = F.col("lag_1").isNotNull() & F.col("lag_2").isNotNull() & F.col("lag_3").isNotNull()
    mean = (F.col("lag_1") + F.col("lag_2") + F.col("lag_3")) / 3.0
    value = F.greatest(F.lit(LEAST_DEMAND), mean + (F.col("lag_1") - F.col("lag_3")) * TREND_WEIGHT)
    return df.withColumn("predicted_demand", F.when(complete, two_digits(value)))
