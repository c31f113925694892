import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.plans import shipments
from harborline.plans.scoring import keep_failed, score_risk
from harborline.sources.bindings import order_events
from harborline.streaming import marts, recent
from harborline.streaming import orders as live


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "data")
    kinds = ["purchase", "view", "error", "click", "signup"]
    rows = [
        (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=3 * i), i % 9, kinds[i % 5], float(i % 400) + 0.5, '{"k": %d}' % (i % 100) if i % 50 else "{}")
        for i in range(1000)
    ]
    df = spark.createDataFrame(rows, live.EVENT_SCHEMA)
    for part in range(4):  # one file after the other: the source reads them by age, so event time does not go back
        df.filter(F.col("event_id").between(250 * part, 250 * part + 249)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder, files=1):
    return order_events(live.read_events(spark, folder, files_per_trigger=files))


def batch(spark, folder):
    return order_events(spark.read.schema(live.EVENT_SCHEMA).parquet(folder))


def rows(df):
    return sorted(df.collect(), key=str)


def test_ledger_equals_batch_scoring_and_keeps_failed_orders(spark, folder):
    ledger = live.drain_to_files(live.score_orders(stream(spark, folder)), "ledger")
    columns = ["event_id", "delivery_risk", "anomaly_prediction", "supply_chain_risk", "risk_category"]
    assert rows(ledger.select(*columns)) == rows(keep_failed(score_risk(batch(spark, folder))).select(*columns))
    failed = ledger.filter("risk_category = 'Unknown'")
    assert failed.count() == 20 and failed.filter("supply_chain_risk <> 0").count() == 0
    newest = live.last_points(ledger, 30).select("event_id")
    assert sorted(r[0] for r in newest.collect()) == list(range(970, 1000))
    event = live.as_pipeline_event(ledger).filter("event_id = 1").first().event
    assert '"type":"pipeline_tick"' in event and '"shipment_status":"In Transit"' in event
    records = shipments.live_records(ledger)
    assert {r.progress for r in records.select("progress").distinct().collect()} == {100, 72, 46}


def test_running_counts_equal_batch_counts(spark, folder):
    assert rows(live.drain_latest(live.status_counts(stream(spark, folder)), "status")) == rows(live.status_counts(batch(spark, folder)))
    rates = live.drain_latest(live.mode_late_rate(stream(spark, folder)), "modes")
    assert rows(live.worst_modes(rates)) == rows(live.worst_modes(live.mode_late_rate(batch(spark, folder))))


def test_restarted_jobs_go_on_where_they_stopped(spark, folder, tmp_path):
    path = str(tmp_path / "ledger")
    first = rows(live.drain_to_files(live.score_orders(stream(spark, folder)), "ledger", path))
    again = rows(live.drain_to_files(live.score_orders(stream(spark, folder)), "ledger", path))
    assert len(first) == 1000 and again == first
    path = str(tmp_path / "status")
    first = rows(live.drain_latest(live.status_counts(stream(spark, folder)), "status", path))
    again = rows(live.drain_latest(live.status_counts(stream(spark, folder)), "status", path))
    assert again == first == rows(live.status_counts(batch(spark, folder)))


def test_unknown_states_count_as_in_transit(spark):
    states = spark.createDataFrame([("Lost",), (None,), ("Delayed",)], "shipment_status string")
    assert {tuple(r) for r in live.status_counts(states).collect()} == {("In Transit", 2), ("Delayed", 1)}


def test_windows_in_append_mode_emit_only_what_is_closed(spark, folder):
    written = live.drain_to_files(live.tumbling_status(stream(spark, folder)), "hours")
    whole = live.tumbling_status(batch(spark, folder))
    emitted = set(written.collect())
    last = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=3 * 999) - dt.timedelta(minutes=10)
    closed = whole.filter(F.col("window_start") + F.expr("interval 1 hour") <= F.lit(last))
    assert emitted <= set(whole.collect()) and set(closed.collect()) >= emitted and len(emitted) > 0
    complete = live.drain_latest(live.tumbling_status(stream(spark, folder)), "hours")
    assert set(complete.collect()) == set(whole.collect())


def test_replayed_files_do_not_count_twice(spark, folder, tmp_path):
    twice = str(tmp_path / "twice")
    spark.read.parquet(folder).union(spark.read.parquet(folder)).repartition(2).write.parquet(twice)
    unique = live.drain_to_files(live.without_replays(stream(spark, twice, files=10)), "unique")
    assert unique.count() == 1000


def test_marts_follow_the_stream_and_go_on_after_a_restart(spark, folder, tmp_path):
    orders = keep_failed(score_risk(batch(spark, folder)))
    for _ in range(2):
        query, store = marts.refresh_marts(live.score_orders(stream(spark, folder)), marts.order_states(), "marts", True, str(tmp_path))
        query.awaitTermination()
        kpis = store.read("kpis").first()
        assert tuple(kpis) == (1000, 200, 400, 200)
    assert store.versions()[0] == 3  # one version per file
    assert rows(store.read("risk")) == rows(marts.order_states()["risk"].of_batch(orders))
    assert rows(store.read("days")) == rows(marts.order_states()["days"].of_batch(orders))
    assert sorted(r.event_id for r in store.read("feed").collect()) == list(range(995, 1000))
    found = {(r.part, r.entry): r.value for r in marts.payloads(store).collect()}
    assert found["dashboard", "on_time_pct"] == 20.0 and found["dashboard", "late_pct"] == 40.0
    assert {part for part, _ in found} == {"dashboard", "activity", "inventory", "forecasting", "shipments", "risk"}
    assert sorted(p.name for p in (tmp_path / "kpis").iterdir()) == ["v=2", "v=3"]  # older states are gone
    counts = shipments.live_counts(orders).first()
    stats = shipments.with_live(shipments.live_counts(orders), shipments.live_counts(orders)).first()
    assert tuple(counts) == (1000, 600, 200, 200) and tuple(stats) == (2000, 1200, 400, 400)


def test_a_batch_reads_no_earlier_rows_and_counts_once(spark, folder, tmp_path):
    orders = keep_failed(score_risk(batch(spark, folder)))
    store = marts.MartStore(spark, str(tmp_path), marts.order_states())
    assert store.versions() == [-1]
    half = orders.where("event_id < 500")
    store.apply(half, 0)
    store.apply(half, 0)  # repeated
    assert store.read("kpis").first().orders == 500
    new = orders.where("event_id >= 500")
    files = store.merged("days", new, 0).inputFiles()
    assert {f for f in files if str(tmp_path) in f} == set(store.read("days").inputFiles())
    marts.order_states()["days"].merged(store.read("days"))
    store.merged("days", new, 0).write.parquet(f"{tmp_path}/days/v=1")  # a batch that failed before its version was listed
    assert store.read("kpis").first().orders == 500
    store.apply(new, 1)
    assert store.read("kpis").first().orders == 1000
    assert rows(store.read("days")) == rows(marts.order_states()["days"].of_batch(orders))


def test_newest_points_equal_the_batch_after_a_restart(spark, folder, tmp_path):
    columns = ["ts", "event_id", "shipment_status"]
    orders = batch(spark, folder).select(F.col("shipping_mode").alias("key"), *columns)
    want = rows(recent.newest_per_key(orders, 7))
    some = str(tmp_path / "events")
    files = sorted(spark.read.parquet(folder).inputFiles(), key=lambda f: spark.read.parquet(f).first().event_id)
    for at, part in enumerate((files[:2], files[2:])):  # the second run goes on where the first stopped
        spark.read.parquet(*part).coalesce(1).write.mode("append").parquet(some)
        points = recent.newest_points(stream(spark, some), "shipping_mode", columns, 7, path=str(tmp_path / "points"))
        assert at == 0 or rows(recent.newest_per_key(points, 7)) == want
    most = points.groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= 7 * recent.SLICES


def test_demand_events_and_series(spark):
    lags = spark.createDataFrame([("t1", 4675.0, 4146.0, 4823.0)], "period string, lag_1 double, lag_2 double, lag_3 double")
    points = live.demand_events(lags)
    assert (points.first().predicted_demand, points.first().rolling_mean_3) == (4525.8, 4548.0)
    series = live.live_demand_series(points).first()
    assert (series.actual, series.forecast, series.upper, series.lower) == (4548.0, 4526.0, 4888.0, 4164.0)
    assert round(live.live_accuracy(points).first().accuracy, 4) == round(100 - 22.2 / 4548 * 100, 4)
