import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from harborline.plans import answers, demand, gold, inventory, kpis, logistics, models, retrieval, risk, scoring, shipments, silver

AS_OF = dt.date(2018, 3, 1)
RAW = [
    "Order Id",
    "order date (DateOrders)",
    "shipping date (DateOrders)",
    "Product Id",
    "Customer Id",
    "Customer Segment",
    "Sales",
    "Order Item Quantity",
    "Order Profit Per Order",
    "Delivery Status",
    "Shipping Mode",
    "Market",
    "Department Name",
    "Class",
]


def raw_sales(spark, rows):
    base = ["1", "1/31/2018 22:56", "2/2/2018 1:00", "10", "7", "Consumer", "99.5", "3", "4.25", "Late delivery", "First Class", "EU", "Fitness", "A"]
    data = []
    for changes in rows:
        row = dict(zip(RAW, base))
        row.update(changes)
        data.append(tuple(row[name] for name in RAW))
    schema = ", ".join(f"`{name}` string" for name in RAW)
    return spark.createDataFrame(data, schema)


def test_silver_sales_and_rejects_partition_the_keyed_rows(spark):
    raw = raw_sales(
        spark,
        [
            {},
            {"shipping date (DateOrders)": "2018-02-05 00:00:00"},  # same key, later shipment: kept
            {"Order Id": "2", "shipping date (DateOrders)": "-"},
            {"Order Id": "3", "order date (DateOrders)": "n/a"},
            {"Order Id": None},
            {"Order Id": "4", "Product Id": None},
            {"Order Id": "5", "Customer Id": None, "Customer Segment": None, "Sales": "abc", "Order Item Quantity": "12.5", "Delivery Status": None},
        ],
    )
    good = {row.order_id: row for row in silver.sales(raw).collect()}
    bad = {row.order_id for row in silver.sales_rejects(raw).collect()}
    assert set(good) == {1, 5} and bad == {2, 3}
    assert good[1].shipment_date == dt.date(2018, 2, 5) and good[1].is_late_delivery == 1
    fixed = good[5]
    assert (fixed.customer_id, fixed.customer_segment, fixed.sales, fixed.quantity, fixed.is_late_delivery) == (-1, "Unknown", 0.0, 0, 0)


def test_silver_accepts_its_own_dates_again(spark):
    raw = raw_sales(spark, [{}, {"Order Id": "9"}])
    once = silver.sales(raw)
    assert set(silver.dedup_sales(once).collect()) == set(once.collect())


def sales_frame(spark, rows):
    schema = "order_id bigint, order_date date, shipment_date date, product_id bigint, customer_id bigint, customer_segment string, sales decimal(18,2), quantity int, profit decimal(18,4), is_late_delivery int, shipping_mode string, market string, department string, class string"
    from decimal import Decimal

    full = []
    for number, row in enumerate(rows):
        base = dict(
            order_id=number, order_date=dt.date(2018, 1, 1) + dt.timedelta(days=number), shipment_date=dt.date(2018, 1, 5), product_id=1,
            customer_id=1, customer_segment="Consumer", sales=100, quantity=2, profit=10, is_late_delivery=0, shipping_mode="First Class",
            market="EU", department="Fitness", **{"class": "A"},
        )
        base.update(row)
        base["sales"], base["profit"] = Decimal(str(base["sales"])), Decimal(str(base["profit"]))
        full.append(tuple(base.values()))
    return spark.createDataFrame(full, schema)


def stock_frame(spark):
    return spark.createDataFrame(
        [(1, 10, 50, 100, 4, 20)], "product_id bigint, lead_time int, current_stock int, reorder_point int, avg_order int, safety_stock int"
    )


def supply_frame(spark):
    rows = [(1, "haircare", 5.0, 3, 2, 1, 1.5, "s1", 2.0), (2, "skincare", 6.0, 3, 2, 1, 2.5, "s1", 4.0), (3, "other", 6.0, 3, 2, 1, 2.5, "s2", 9.0)]
    return spark.createDataFrame(
        rows, "sku bigint, product_type string, revenue double, stock_levels int, lead_times int, shipping_times int, shipping_costs double, supplier_name string, defect_rates double"
    )


def test_gold_flags_fan_out_and_features(spark):
    sales = sales_frame(spark, [{}, {"product_id": 2, "sales": 0, "profit": -1}, {"department": "Health and Beauty", "sales": 400, "quantity": 6}])
    rows = gold.delivery_rows(gold.joined_sales(sales, stock_frame(spark), supply_frame(spark)), AS_OF)
    got = rows.orderBy("order_id", "max_defect_rate").collect()
    assert [r.order_id for r in got] == [0, 1, 2, 2]
    assert [r.lead_time_missing for r in got] == [0, 1, 0, 0] and got[1].lead_time == 0
    assert [r.defect_missing for r in got] == [1, 1, 0, 0] and [r.max_defect_rate for r in got] == [0.0, 0.0, 2.0, 4.0]
    assert got[1].profit_margin is None and got[2].is_high_value == 1 and got[2].is_bulk_order == 1 and got[1].is_profitable == 0
    assert got[0].order_processing_days == 4 and got[0].days_since_shipment == 55 and got[0].day_of_week == 2
    assert got[1].avg_order_value_30d == 50.0 and got[1].num_orders_30d == 2
    assert gold.flat_order_record(rows).columns == gold.FLAT_RECORD and len(gold.FLAT_RECORD) == 32
    assert gold.combined_features(gold.delivery_features(rows), dt.date(2018, 3, 2)).count() == 4 * 0


def test_lone_row_has_zero_deviation_and_zero_cover_without_orders(spark):
    retail = spark.createDataFrame([(dt.date(2018, 1, 1), 1, 5, 7.0, 3)], "date date, store_id int, product_id bigint, sales double, stock int")
    features = gold.inventory_features(gold.inventory_ml_clean(retail, stock_frame(spark)), AS_OF).first()
    assert (features.stddev_sales_30d, features.avg_sales_30d, features.days_inventory_outstanding, features.stock_below_reorder) == (0.0, 7.0, 0.0, 0)


def test_no_replenishment_row_only_when_nothing_is_low(spark):
    schema = "product_id string, store_id int, date date, current_stock int, reorder_point int, stock_below_reorder int"
    full = spark.createDataFrame([("1", 1, AS_OF, 9, 5, 0)], schema)
    low = spark.createDataFrame([("1", 1, AS_OF, 1, 5, 1), ("2", 1, AS_OF, 2, 5, 1)], schema)
    assert [r.title for r in kpis.replenishment_candidates(full).collect()] == ["No replenishment action"]
    assert [r.id for r in kpis.replenishment_candidates(low).orderBy("id").collect()] == ["d1", "d2"]


def test_empty_inventory_gives_zero_accuracy_and_no_turns(spark):
    schema = "current_stock int, stock_below_reorder int, store_sales double, avg_sales_30d double"
    row = kpis.inventory_kpis(spark.createDataFrame([], schema)).first()
    assert (row.reorder_alerts, row.inventory_turns, row.forecast_accuracy) == (0, None, 0.0)


def test_default_risk_record(spark):
    order = spark.createDataFrame([(10.0, 10.0, 1.0, 119.98)], "lead_time double, avg_lead_time_by_mode double, avg_defect_rate double, sales double")
    row = scoring.score_risk(order).first()
    assert (row.delivery_risk, row.anomaly_prediction, row.anomaly_score, row.anomaly_risk) == (15.6, "Normal", 0.25, 12.0)
    assert (row.supply_chain_risk, row.risk_category) == (14.16, "Low")


def test_risk_defaults_limits_and_failures(spark):
    empty = scoring.score_risk(spark.range(1)).first()
    assert (empty.delivery_risk, empty.anomaly_risk) == (15.5, 12.0)
    rows = spark.createDataFrame([(40.0, 5.0), (12.5, 5.0), (None, 5.0)], "lead_time double, avg_lead_time_by_mode double")
    far, slow, failed = scoring.keep_failed(scoring.score_risk(rows)).collect()
    assert (far.delivery_risk, far.anomaly_risk, far.anomaly_prediction, far.risk_category) == (95.0, 98.0, "Anomaly", "High")
    assert slow.anomaly_prediction == "Anomaly"
    assert (failed.delivery_risk, failed.anomaly_prediction, failed.risk_category) == (0.0, "Error", "Unknown")


def test_default_demand(spark):
    lags = spark.createDataFrame([(4675.0, 4146.0, 4823.0), (1.0, 1.0, 1.0), (None, 1.0, 1.0)], "lag_1 double, lag_2 double, lag_3 double")
    assert [r.predicted_demand for r in scoring.forecast_demand(lags).collect()] == [4525.8, 10.0, None]


def test_demand_smoothing_and_band(spark):
    rows = [(dt.date(2018, 1, 1) + dt.timedelta(weeks=i), units) for i, units in enumerate([100, 200, 300])]
    history = spark.createDataFrame([(day, units, None, None) for day, units in rows], "order_date date, quantity int, units_sold double, date date")
    points = demand.history_points(history).collect()
    # 0.5 a + 0.3 previous + 0.2 next, the edge weeks standing in for their missing neighbour
    assert [p.forecast for p in points] == [120, 190, 270]
    assert [(p.upper, p.lower) for p in points] == [(140, 100), (205, 175), (300, 240)]
    summary = demand.intelligence_history(history).first()
    assert round(summary.accuracy, 6) == 90.0 and round(summary.demand_delta, 6) == round(-20 / 600 * 100, 6)
    assert summary.demand_risk == "Medium" and summary.points == 3
    only = demand.history_points(history, "jan-2018").agg(F.sum("actual")).first()[0]
    assert only == 600


def test_monthly_mix_counts_overlap_and_rows_with_two_dates_count_twice(spark):
    schema = "order_date date, date date, is_late_delivery int, shipment_date date, lead_time int, avg_lead_time_by_mode double, profit double"
    jan, feb = dt.date(2018, 1, 5), dt.date(2018, 2, 5)
    history = spark.createDataFrame(
        [(jan, feb, 1, dt.date(2018, 4, 1), 10, 5.0, -1.0), (None, feb, None, None, None, None, None), (None, None, 1, None, None, None, None)], schema
    )
    months = {r.id: r for r in logistics.monthly_logistics(logistics.dated_rows(history), AS_OF).collect()}
    assert set(months) == {"jan-2018", "feb-2018"}
    assert (months["jan-2018"].delayed, months["jan-2018"].at_risk, months["jan-2018"].in_transit, months["jan-2018"].returned) == (1, 1, 1, 1)
    assert (months["feb-2018"].delivered, months["feb-2018"].delayed) == (1, 1)
    slices = logistics.logistics_slices(logistics.monthly_logistics(logistics.dated_rows(history), AS_OF))
    assert slices.count() == 10
    shares = logistics.slice_share(slices).groupBy("id").agg(F.sum("share_pct").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-9 for r in shares)
    assert len(logistics.by_month_map(slices).first().by_month["jan-2018"]) == 5


def test_weekday_calendar_fills_gaps_and_adds_live_counts(spark):
    means = spark.createDataFrame([("Thu", 2.5, 1.0, 0.0)], "weekday string, on_time double, delayed double, at_risk double")
    live = spark.createDataFrame([(7, 4, 2, 1)], "total int, on_time int, delayed int, at_risk int")
    rows = logistics.weekday_calendar(means, AS_OF, live).orderBy("calendar_day").collect()
    assert [r.day for r in rows] == ["Fri", "Sat", "Sun", "Mon", "Tue", "Wed", "Thu"]
    assert [r.on_time for r in rows] == [0, 0, 0, 0, 0, 0, 6] and rows[-1].delayed == 3


def test_shipment_score_and_status(spark):
    schema = "is_late_delivery int, lead_time int, avg_lead_time_by_mode double, late_delivery_rate_by_mode double, profit double"
    rows = [(1, 10, 5.0, 0.5, -1.0), (1, 10, None, 0.5, 1.0), (0, 10, 5.0, 0.9, -1.0), (1, 10, 0.0, 0.7, 1.0)]
    got = shipments.scored(spark.createDataFrame(rows, schema)).collect()
    assert [(r.risk_score, r.status) for r in got] == [(75.0, "At Risk"), (50.0, "Delayed"), (100.0, "Delivered"), (70.0, "At Risk")]


def test_risk_matrix_and_summary(spark):
    metrics = spark.sql(
        "SELECT 80.0D AS late_probability, 90.0D AS late_impact, 0.0D AS margin_probability, 10.0D AS stockout_probability, "
        "200.0D AS demand_volatility, 50.0D AS overstock_probability, CAST(NULL AS DOUBLE) AS supplier_probability, 500.0D AS supplier_impact"
    )
    matrix = risk.risk_matrix(metrics)
    got = {r.category: (r.probability, r.impact, r.exposure) for r in matrix.collect()}
    assert got["Delivery Delay"] == (80, 90, 84) and got["Demand Shock"] == (100, 72, 87)
    assert got["Supplier Quality"] == (0, 100, 45) and got["Overstock"] == (50, 54, 52)
    summary = risk.risk_summary(matrix).first()
    assert (summary.high_exposure, summary.anomalies, summary.resolved) == (2, 4, 4)


def test_exact_answers_are_texts_in_rank_order(spark):
    sales = sales_frame(spark, [{"product_id": i % 7, "sales": 10 + i, "quantity": i, "profit": 1 - i} for i in range(40)])
    flat = gold.flat_order_record(gold.delivery_rows(gold.joined_sales(sales, stock_frame(spark), supply_frame(spark)), AS_OF))
    documents = {r.source: r.content for r in answers.answer_documents(flat).collect()}
    assert len(documents) == 8
    ranking = documents["Full-dataset product-sales calculation"].split("\n")
    assert len(ranking) == 6 and ranking[1].startswith("1. Product ID 4: total sales $")
    assert documents["Full-dataset quantity calculation"].split("\n")[1] == "Order 39: quantity 39; sales $49.00; product ID 4."
    assert ranking[0] == "Exact product-sales ranking calculated from all 40 available order rows:"
    bulk = documents["Full-dataset unprofitable bulk-order calculation"].split("\n")
    assert bulk[0].endswith(": 34 bulk orders are not profitable.") and len(bulk) == 12
    part = {r.source: r.content for r in answers.answer_documents(flat.filter("order_id < 4"), flat).collect()}
    assert part["Full-dataset quantity calculation"].startswith("Exact largest-quantity orders from the requested time period (4 order rows):")
    wanted = spark.createDataFrame([(3,), (3,), (99,)], "order_id bigint")
    assert [r.order_id for r in answers.order_lookup(flat, wanted).collect()] == [3]


def test_stock_list_puts_short_rows_first(spark):
    schema = "product_id string, store_id int, date date, current_stock int, reorder_point int, days_inventory_outstanding double"
    rows = [("1", 1, AS_OF, 500, 10, 1.5), ("2", 1, AS_OF, 9, 10, 2.5), ("2", 1, dt.date(2017, 1, 1), 1, 10, 0.0), ("3", 1, AS_OF, 0, 0, 0.0)]
    sales = sales_frame(spark, [{"product_id": 2, "department": "Pets"}])
    items = inventory.items(spark.createDataFrame(rows, schema), sales).orderBy("position").collect()
    assert [(i.sku, i.status, i.category, i.days_of_cover) for i in items] == [
        ("2", "Low", "Pets", 2), ("3", "Healthy", "General", 0), ("1", "Overstock", "General", 2),
    ]


def test_chunks_format_values_and_collapse_by_id(spark):
    sales = sales_frame(spark, [{"department": "Health and Beauty", "sales": "12.50"}])
    flat = gold.flat_order_record(gold.delivery_rows(gold.joined_sales(sales, stock_frame(spark), supply_frame(spark)), AS_OF))
    chunks = retrieval.build_chunks(flat)
    assert chunks.count() == 2
    row = chunks.first()
    lines = row.text.split("\n")
    assert row.id == "order_0_product_1" and lines[0] == "Order record:" and len(lines) == 33
    assert "Sales: 12.5" in lines and "Order Date: 2018-01-01" in lines and row.metadata["quantity"] == "2"
    kept = retrieval.latest_chunks(chunks, [F.element_at("metadata", "order_date").desc()])
    assert kept.count() == 1
    missing = retrieval.build_chunks(flat.withColumn("product_id", F.lit(None).cast("bigint"))).first()
    assert missing.id == "order_0_product_N/A" and "Product Id: N/A" in missing.text


def test_upsert_replaces_and_pending_resumes(spark):
    stored = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, text string")
    incoming = spark.createDataFrame([("b", "new"), ("c", "new")], "id string, text string")
    assert [r.id for r in retrieval.pending(incoming, stored).collect()] == ["c"]


def test_rerank_drops_weak_empty_and_repeated(spark):
    rows = [("q", 1, 0.9, "same "), ("q", 2, 0.8, " same"), ("q", 3, 0.7, "  "), ("q", 4, 0.66, "other"), ("q", 5, 0.64, "weak")]
    got = retrieval.rerank(spark.createDataFrame(rows, "query_id string, id int, score double, content string")).orderBy("rank").collect()
    assert [(r.id, r.rank, r.content) for r in got] == [(1, 1, "same"), (4, 2, "other")]
    many = [("q", i, 1.0 - i / 100, f"text {i}") for i in range(30)]
    kept = retrieval.rerank(spark.createDataFrame(many, "query_id string, id int, score double, content string"), 2, 0.0)
    assert kept.count() == 2


def packed(records):
    budget, share, sections = 12_000, max(1000, 12_000 // max(1, len(records))), []
    for number, (source, content) in enumerate(records, 1):
        content = content.strip()
        if not content or budget <= 0:
            continue
        allowed = min(share, budget)
        section = f"[Record {number} | Source: {source}]\n{content}"
        if len(section) > allowed:
            head = section[:allowed]
            section = (head[: head.rindex(" ")] if " " in head else head) + "…"
        sections.append(section)
        budget -= len(section)
    return "\n\n---\n\n".join(sections)


def test_context_pack_matches_a_plain_loop(spark):
    pick = random.Random(9)
    text = lambda n: " ".join("x" * pick.randrange(1, 12) for _ in range(n))
    cases = {f"q{i}": [(f"s{j}", pick.choice(["", text(30), text(900), text(4000), "y" * 5000])) for j in range(i + 1)] for i in range(14)}
    rows = [(q, j + 1, source, content) for q, records in cases.items() for j, (source, content) in enumerate(records)]
    df = spark.createDataFrame(rows, "query_id string, rank int, source string, content string")
    got = {r.query_id: r.context for r in retrieval.context_pack(df).collect()}
    assert got == {q: packed(records) for q, records in cases.items()}


def test_labels_confidence_and_urgency(spark, one):
    label = lambda pairs, match: one(
        retrieval.source_label(F.create_map(*[F.lit(x).cast("string") for p in pairs for x in p]), F.lit(match).cast("string"))
    )
    assert label([("table", "gold"), ("source", "s")], "m") == "gold"
    assert label([("table", ""), ("filename", "f.md")], "m") == "f.md"
    assert label([("order_id", "7")], "m") == "Order 7"
    assert label([("x", "y")], "m") == "m" and label([("x", "y")], "") == "Knowledge Base"
    matches = spark.createDataFrame([("a", 0.5), ("a", 0.755), ("b", 1.7)], "query_id string, score double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    assert {r.query_id: r.confidence for r in retrieval.confidence(matches, asked).collect()} == {"a": 0.63, "b": 1.0, "c": 0.0}
    assert one(retrieval.is_urgent(F.lit("A Stock Out near us"))) and not one(retrieval.is_urgent(F.lit("sales by month")))


@pytest.mark.parametrize("rows", [400])
def test_models_fit_and_predict(spark, rows):
    pick = random.Random(1)
    data = [
        {"product_id": pick.randrange(5), "sales": pick.randrange(10, 500), "is_late_delivery": int(i % 3 == 0), "shipping_mode": "Same Day" if i % 3 == 0 else "First Class"}
        for i in range(rows)
    ]
    flat = gold.flat_order_record(gold.delivery_rows(gold.joined_sales(sales_frame(spark, data), stock_frame(spark), supply_frame(spark)), AS_OF)).cache()
    scored = models.predict_delay(models.fit_delay(flat, trees=5, depth=3), flat)
    assert models.delay_auc(scored) > 0.9
    assert scored.agg(F.min("delivery_risk") >= 0, F.max("delivery_risk") <= 100).first() == (True, True)
    anomalies = models.anomaly_risk(flat, trees=10)
    low, high, count = anomalies.agg(F.min("anomaly_risk"), F.max("anomaly_risk"), F.count("*")).first()
    assert (low, high, count) == (0.0, 100.0, flat.count())
    lags = demand.monthly_lags(flat, ["product_id"])
    predicted = models.predict_demand(models.fit_demand(lags, trees=5, depth=3), lags)
    assert predicted.count() == lags.dropna(subset=["lag_3"]).count() and models.demand_rmse(predicted) >= 0


def test_equal_documents_are_stored_once_and_empty_ones_kept(spark):
    rows = [("a", "web"), ("a", "mail"), ("", None), (None, "web"), (" ", "web")]
    stored = retrieval.documents_to_vectors(spark.createDataFrame(rows, "content string, source string")).collect()
    assert sorted((r.content, r.source) for r in stored) == [("", "unknown"), (" ", "web"), ("a", "mail")]
    assert len({r.id for r in stored}) == 3


def test_latest_texts_equal_latest_chunks_and_sort_no_text(spark):
    sales = sales_frame(spark, [{"order_id": 5, "order_date": dt.date(2018, 1, 1 + i % 2), "department": "Health and Beauty", "sales": 10 + i} for i in range(6)])
    flat = gold.flat_order_record(gold.delivery_rows(gold.joined_sales(sales, stock_frame(spark), supply_frame(spark)), AS_OF))
    flat = flat.unionByName(flat.withColumn("product_id", F.lit(None).cast("bigint"))).unionByName(flat.withColumn("order_date", F.lit(None).cast("date")))
    newest = [F.element_at("metadata", name).desc() for name in ("order_date", "shipment_date")]
    want = retrieval.latest_chunks(retrieval.build_chunks(flat), newest).select("id", "text")
    got = retrieval.latest_texts(flat, [retrieval.field_text(flat, name).desc() for name in ("order_date", "shipment_date")])
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.split("\n") if " Sort [" in line or "Exchange hashpartitioning(id" in line]
    assert sorts and not any("text" in line for line in sorts)


def test_rows_to_learn_from_are_spread_over_tasks(spark):
    few = spark.range(1000, numPartitions=2)
    assert models.spread(few, 500).rdd.getNumPartitions() == 2
    sizes = models.spread(few, 100).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 150


def test_product_ranking_counts_orders_without_hashing_all_pairs(spark):
    rows = [(o, p, f"{o * p % 13}.50", f"{o - p}.25") for o in range(30) for p in range(6) if (o + p) % 4] * 2
    rows += [(None, 1, "7.00", "1.00"), (3, None, "900.00", "2.00"), (3, None, None, None), (4, None, "1.00", "1.00"), (None, 9, "800.00", "0.00")]
    df = spark.createDataFrame(rows, "order_id bigint, product_id bigint, s string, p string").repartition(3)
    records = df.select("order_id", "product_id", F.col("s").cast("decimal(18,2)").alias("sales"), F.col("p").cast("decimal(18,2)").alias("profit"))
    got = answers.product_sales_rank(records, 5)
    plain = records.groupBy("product_id").agg(F.sum("sales").cast("double"), F.sum("profit").cast("double"), F.countDistinct("order_id"))
    want = sorted((tuple(r) for r in plain.collect()), key=lambda r: (-r[1], r[0] or -1))[:5]
    assert [tuple(r)[:4] for r in got.orderBy("rank").collect()] == want and (9, 800.0, 0.0, 0) in want
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
