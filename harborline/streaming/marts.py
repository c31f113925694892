"""Marts kept up to date by micro-batches: partial results are merged into stored states, readers follow a version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions.measures import count_where
from harborline.plans import shipments
from harborline.session import fresh_path, remove
from harborline.streaming.orders import REFRESH

TOTAL = "decimal(38,2)"  # sums of it are exact, whatever batches the rows come in
FEED_ROWS, SHIPMENT_ROWS, DAYS_SHOWN = 5, 20, 10
VERSION = T.StructType([T.StructField("version", T.LongType())])


@dataclass(frozen=True)
class Sums:
    """A state of sums by key: ``keys`` and ``measures`` are computed per batch, then added up."""

    keys: dict[str, Column]
    measures: dict[str, Column]

    def of_batch(self, batch: DataFrame) -> DataFrame:
        return batch.groupBy(*(key.alias(name) for name, key in self.keys.items())).agg(*(measure.alias(name) for name, measure in self.measures.items()))

    def merged(self, states: DataFrame) -> DataFrame:
        kinds = dict(states.dtypes)
        return states.groupBy(*self.keys).agg(*(F.sum(name).cast(kinds[name]).alias(name) for name in self.measures))


@dataclass(frozen=True)
class Newest:
    """A state of the newest rows: those of a batch and those before it, cut to ``rows`` again."""

    rows: int
    order: tuple[str, ...] = ("ts", "event_id")
    columns: tuple[str, ...] = field(default=("*",))

    def of_batch(self, batch: DataFrame) -> DataFrame:
        return self.merged(batch.select(*self.columns))

    def merged(self, states: DataFrame) -> DataFrame:
        return states.orderBy(*(F.col(name).desc() for name in self.order)).limit(self.rows)


State = Sums | Newest


class MartStore:
    """States of several marts in a folder, one folder per mart and version; a table lists the complete versions.

    A micro-batch reads its own rows and the states of the version before, never the rows of earlier batches. The version is the number of
    the batch: it is listed once all states are written, so readers see all marts of one batch or of the one before, a
    batch that fails half-way is written again, and one that is repeated afterwards adds nothing.
    """

    def __init__(self, spark: SparkSession, root: str, states: dict[str, State]):
        self.spark, self.root, self.states = spark, root, states
        self._list(-1)  # the table exists from the start

    def _list(self, version: int) -> None:
        self.spark.createDataFrame([(version,)], VERSION).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    def versions(self) -> list[int]:
        """The newest complete versions, the newest first; -1 stands for none."""
        listed = self.spark.read.schema(VERSION).parquet(f"{self.root}/versions")
        return [r.version for r in listed.distinct().orderBy(F.desc("version")).limit(3).collect()]

    def merged(self, mart: str, batch: DataFrame, before: int) -> DataFrame:
        """The state of a mart after a batch, from the state of the version before."""
        state = self.states[mart]
        new = state.of_batch(batch)
        return state.merged(new.unionByName(self.spark.read.schema(new.schema).parquet(self._path(mart, before))) if before >= 0 else new)

    def apply(self, batch: DataFrame, number: int) -> None:
        known = self.versions()
        if number <= known[0]:
            return
        batch = batch.persist()
        for mart in self.states:
            self.merged(mart, batch, known[0]).write.mode("overwrite").parquet(self._path(mart, number))
        batch.unpersist()
        self._list(number)
        for mart in self.states:  # readers may still be at the version before, not at those before that
            for old in known[1:]:
                remove(self.spark, self._path(mart, old))

    def _path(self, mart: str, version: int) -> str:
        return f"{self.root}/{mart}/v={version}"

    def read(self, mart: str, version: int | None = None) -> DataFrame:
        """The state of a mart in a version, by default the newest complete one."""
        return self.spark.read.parquet(self._path(mart, self.versions()[0] if version is None else version))


def refresh_marts(stream: DataFrame, states: dict[str, State], name: str, once: bool = False, path: str | None = None):
    """Keep the states of all marts up to date with a stream; started again with the same ``path`` the job goes on where it stopped.

    Returns the running query and the store to read from.
    """
    spark = stream.sparkSession
    root = path or fresh_path(spark, name)
    store = MartStore(spark, root, states)
    trigger = {"availableNow": True} if once else {"processingTime": REFRESH}
    query = stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()
    return query, store


def _is(*names: str) -> Column:
    return F.col("shipment_status").isin(*names)


def _money(column: str) -> Column:
    return F.coalesce(F.sum(F.col(column).cast(TOTAL)), F.lit(0)).cast(TOTAL)


def order_states() -> dict[str, State]:
    """What the live payloads are made of."""
    orders = F.count(F.lit(1))
    return {
        "kpis": Sums({}, {"orders": orders, "delivered": count_where(_is("Delivered")), "late": count_where(_is("Delayed", "At Risk")), "returned": count_where(_is("Returned"))}),
        "feed": Newest(FEED_ROWS),
        "stock": Sums({"shipment_status": F.col("shipment_status")}, {"orders": orders, "value": _money("sales")}),
        "days": Sums({"day": F.to_date("ts")}, {"orders": orders, "value": _money("sales")}),
        "shipments": Newest(SHIPMENT_ROWS),
        "risk": Sums({"shipping_mode": F.col("shipping_mode"), "risk_category": F.col("risk_category")}, {"orders": orders, "score": _money("supply_chain_risk")}),
    }


def dashboard(read: Callable[[str], DataFrame]) -> DataFrame:
    """Headline measures of all orders so far, one row each."""
    kpis = read("kpis")
    share = lambda part: F.when(F.col("orders") > 0, F.col(part) * 100.0 / F.col("orders"))
    cells = {"orders": F.col("orders") * 1.0, "on_time_pct": share("delivered"), "late_pct": share("late"), "returned": F.col("returned") * 1.0}
    return kpis.select(F.explode(F.array(*(F.struct(F.lit(k).alias("entry"), F.round(v, 6).alias("value")) for k, v in cells.items()))).alias("c")).select("c.*")


def activity(read: Callable[[str], DataFrame]) -> DataFrame:
    """The newest orders, each with its state and risk."""
    return read("feed").select(F.concat_ws(" ", "event_id", "shipment_status").alias("entry"), F.col("supply_chain_risk").alias("value"))


def stock(read: Callable[[str], DataFrame]) -> DataFrame:
    """Value of the goods in each shipment state."""
    return read("stock").select(F.col("shipment_status").alias("entry"), F.col("value").cast("double").alias("value"))


def forecast(read: Callable[[str], DataFrame]) -> DataFrame:
    """The last days' value of orders and, as forecast, the mean of the three days before each."""
    days = read("days")
    before = Window.orderBy("day").rowsBetween(-3, -1)  # one row per day
    series = days.select("day", "value", F.avg("value").over(before).alias("forecast")).orderBy(F.desc("day")).limit(DAYS_SHOWN)
    cells = [F.struct(F.concat_ws(" ", F.lit(name), F.col("day").cast("string")).alias("entry"), F.round(F.col(column).cast("double"), 2).alias("value")) for name, column in (("actual", "value"), ("forecast", "forecast"))]
    return series.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def shipped(read: Callable[[str], DataFrame]) -> DataFrame:
    """The newest shipments in the shape of shipment rows."""
    rows = shipments.live_records(read("shipments"))
    return rows.select(F.concat_ws(" ", "id", "carrier", "status", F.col("progress").cast("string")).alias("entry"), F.col("risk_score").cast("double").alias("value"))


def risk(read: Callable[[str], DataFrame]) -> DataFrame:
    """Mean risk score by shipping mode and risk category."""
    mean = F.round((F.col("score") / F.col("orders")).cast("double"), 4)
    return read("risk").select(F.concat_ws(" / ", "shipping_mode", "risk_category").alias("entry"), mean.alias("value"))


PAYLOADS = {"dashboard": dashboard, "activity": activity, "inventory": stock, "forecasting": forecast, "shipments": shipped, "risk": risk}


def payloads(store: MartStore) -> DataFrame:
    """All payloads of one version as rows (``part``, ``entry``, ``value``)."""
    version = store.versions()[0]

    def read(mart: str) -> DataFrame:
        return store.read(mart, version)

    parts = [build(read).select(F.lit(name).alias("part"), "entry", "value") for name, build in PAYLOADS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
