"""The newest points of each key, kept as bounded state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harborline.session import fresh_path
from harborline.streaming.orders import POINTS_KEPT

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SLICES = 16  # a busy key is kept in so many parts, so that no task has to take all rows of a key
EXPIRY_DAYS = 30  # points of a key are forgotten when the stream is so far beyond the newest of them


class NewestPoints(StatefulProcessor):
    """Keeps the ``rows`` newest points of a key as list state and gives them out whenever one of them changes."""

    def __init__(self, schema: T.StructType, rows: int, order: tuple[str, ...], expiry_days: int):
        self.schema, self.rows, self.order, self.expiry_days = schema, rows, order, expiry_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", self.schema)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = self.schema.names
        place = [names.index(name) for name in self.order]

        def rank(point: tuple) -> tuple:
            return tuple(point[at] for at in place)

        held = [tuple(point) for point in self.points.get()] if self.points.exists() else []
        best = set(held)
        for row in rows:  # never more points at hand than twice those kept
            best.add(tuple(row[name] for name in names))
            if len(best) >= 2 * self.rows:
                best = set(sorted(best, key=rank)[-self.rows :])
        newest = sorted(best, key=rank)[-self.rows :]
        if newest == held:
            return
        self.points.put(newest)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = newest[-1][place[0]] // 1000 + self.expiry_days * 24 * 3600 * 1000  # in ms; the points hold microseconds
        self.handle.registerTimer(at)
        self.timer.update((at,))
        part, cut = key
        for point in newest:
            yield Row(key=part, slice=cut, **dict(zip(names, point)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.points.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_points(stream: DataFrame, key: str, columns: list[str], rows: int = POINTS_KEPT, order: tuple[str, ...] = ("ts", "event_id"), expiry_days: int = EXPIRY_DAYS, path: str | None = None) -> DataFrame:
    """Run a stream over all available input and return the newest points of each key, ``rows`` from each of its parts.

    The state of a key is a list of at most ``rows`` points in each of SLICES parts (by a hash of the last order column): its size
    follows the number of keys, not that of the orders, and a busy key is spread. A reader cuts the union of the
    parts (``newest_per_key``, or ``last_points`` over all keys). A batch writes the lists it changed into a folder of its own, so a repeated batch replaces
    itself; the last list of a part counts. Repeated points are one. Points without a place in the order are left out, and so are
    points more than ``expiry_days`` behind the newest of the stream, for which the state of a key is given up too.
    A job that is started again with the same ``path`` goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "newest")
    part = F.pmod(F.xxhash64(order[-1]), F.lit(SLICES)).cast("int").alias("slice")
    timed = stream.withWatermark(order[0], f"{expiry_days} days")
    times = [name for name in columns if isinstance(timed.schema[name].dataType, T.TimestampType)]
    # Times are numbers in the state, which do not depend on a time zone.
    cells = [F.unix_micros(name).alias(name) if name in times else F.col(name) for name in columns]
    points = timed.select(F.col(key).alias("key"), part, *cells).dropna(subset=list(order))
    schema = T.StructType([T.StructField(name, points.schema[name].dataType) for name in columns])
    out = T.StructType([points.schema["key"], points.schema["slice"], *schema.fields])
    processor = NewestPoints(schema, rows, order, expiry_days)
    lists = points.groupBy("key", "slice").transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="EventTime")
    known = T.StructType([*out.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], out).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # list state needs it; a running query keeps the one it began with
    try:
        query = lists.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}-state").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    written = spark.read.schema(known).parquet(path)
    last = written.groupBy("key", "slice").agg(F.max("batch").alias("batch"))
    back = [F.timestamp_micros(name).alias(name) if name in times else F.col(name) for name in columns]
    return written.join(last, ["key", "slice", "batch"]).select("key", *back)


def newest_per_key(points: DataFrame, rows: int = POINTS_KEPT, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The ``rows`` newest points of each key, numbered from the newest."""
    newest = Window.partitionBy("key").orderBy(*(F.col(name).desc() for name in order))
    return points.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= rows)
