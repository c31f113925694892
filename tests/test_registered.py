"""Registered queries against their check SQL on the smallest benchmark tables, and the shape of their plans."""

import math
import os

import duckdb
import pytest

from harborline.operators import rolling
from registry import catalog
from registry import layers as built
from registry.layers import Layers

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# one or two of every family; check.py runs all of them
COMPARED = [
    "kpi_metrics",
    "silver_sales",
    "silver_supply_chain",
    "dedup_sales",
    "gold_sales_ml_clean",
    "gold_inventory_features",
    "flat_order_record",
    "rolling_customer_30",
    "monthly_logistics",
    "demand_intelligence_hist",
    "risk_matrix",
    "inventory_items",
    "latest_shipments",
    "time_scope_filter",
    "exact_answer_docs",
    "row_to_chunk_text",
    "keyword_topk",
    "cosine_topk",
    "context_pack",
    "stream_score_orders",
]
# every operator that joins, combines or windows
LAZY = [
    "join_sales_inventory",
    "join_supply_chain_theta",
    "join_retail_inventory",
    "join_inventory_category",
    "cross_join_scalars",
    "history_live_overlay",
    "kpi_metrics",
    "insight_severity",
    "replenishment_candidates",
    "activity_feed",
    "risk_summary",
    "flat_order_record",
    "rolling_customer_30",
    "order_lookup",
    "time_scope_filter",
    "live_forecast_overlay",
    "upsert_chunks",
    "monthly_logistics",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are absent")


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(float(value) + 0.0) if isinstance(value, (int, float)) else str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, db, name):
    frame = catalog.queries()[name](spark, FOLDER)
    result = db.execute(catalog.oracle_sql()[name])
    columns = [entry[0] for entry in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert table(frame.columns, frame.collect()) == table(columns, result.fetchall())


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join(spark, name):
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_month_filter_reaches_the_scan(spark):
    plan = catalog.queries()["month_range_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_unused_windows_and_copies_are_pruned(spark):
    plan = catalog.queries()["kpi_delivery"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "by_mode" not in plan and "_30d" not in plan


def test_every_query_but_the_fitted_models_has_sql():
    assert set(catalog.JOBS) - set(catalog.oracle_sql()) == {"ml_delivery_delay", "ml_anomaly", "ml_demand"}


def test_window_readers_join_the_order_rows_once(spark):
    """The rows that the moving windows read again are a stored table, and no customer of these tables needs blocks."""
    layers = Layers(spark, FOLDER).stored
    plan = layers.flat._jdf.queryExecution().optimizedPlan().toString()
    assert layers.heavy_customers is None and "l_orderkey" not in plan and plan.count("Union") == 1


def test_layer_counts_rank_no_silver_rows(spark):
    """Of the tables counted, only the gold one reads columns of its first rows; the silver ones are counted by their keys."""
    plan = catalog.queries()["layer_row_counts"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "max(struct" not in plan and "Supplier name" not in plan


def test_moving_windows_read_tables_dealt_by_their_keys(spark):
    tables = lambda: {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    before = tables()
    plan = Layers(spark, FOLDER).stored.flat._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2, plan
    assert [name.rsplit("_", 1)[0] for name in tables() - before] == ["rows_by_shipping_mode"] * 2


def test_dealt_tables_give_the_same_rows_where_customers_are_heavy(spark, monkeypatch):
    plain, order = Layers(spark, FOLDER).flat, ["order_id", "product_id", "order_date", "max_defect_rate", "avg_order_value_30d", "num_orders_30d"]
    monkeypatch.setattr(built, "heavy_keys", lambda df, keys: rolling.heavy_keys(df, keys, 45))
    stored = Layers(spark, FOLDER).stored
    assert stored.heavy_customers is not None
    assert stored.flat.exceptAll(plain).count() == 0 == plain.exceptAll(stored.flat).count()


def test_fitted_models_store_the_columns_they_read(spark, monkeypatch):
    stored, write = {}, catalog.written
    monkeypatch.setattr(catalog, "written", lambda df, name: stored.setdefault(name, df.columns) and write(df, name))
    catalog.queries()["ml_anomaly"](spark, FOLDER)
    assert {"order_id", "product_id", "sales"} <= set(stored["flat"]) and not {"customer_segment", "class", "market"} & set(stored["flat"])
    stored.clear()
    catalog.queries()["ml_delivery_delay"](spark, FOLDER)
    assert "is_late_delivery" in stored["flat"] and "order_id" not in stored["flat"]


def test_purge_of_the_delivery_table_shuffles_no_rows_by_month(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rows are gathered already")

    monkeypatch.setattr(catalog.files, "by_month", refused)
    assert catalog.queries()["purge_usual_value"](spark, FOLDER).count() == 5
