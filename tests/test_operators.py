import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harborline.functions import measures
from harborline.operators import isolation, joins, keep, nearest, rolling
from harborline.plans import gold

ORDER = ["order_date", "order_id", "product_id"]


def orders(spark, rows=3000, days=40, seed=3):
    """Orders in which one customer and one mode hold a third of all rows, and one day a third of those."""
    pick = random.Random(seed)
    data = []
    for number in range(rows):
        hot = pick.random() < 1 / 3
        day = 7 if hot and pick.random() < 1 / 3 else pick.randrange(days)
        data.append(
            (
                number * 7 % rows,
                number % 11,
                dt.date(2020, 1, 1) + dt.timedelta(days=day),
                0 if hot else pick.randrange(1, 60),
                "hot" if hot else f"m{pick.randrange(3)}",
                float(pick.randrange(1, 1000)),
                pick.randrange(20),
                pick.randrange(2),
            )
        )
    schema = "order_id bigint, product_id bigint, order_date date, customer_id bigint, shipping_mode string, sales double, lead_time int, is_late_delivery int"
    return spark.createDataFrame(data, schema)


def expected(df, key, value):
    rows = df.toPandas().sort_values([key, *ORDER])
    rows["mean"] = rows.groupby(key)[value].transform(lambda s: s.rolling(30, min_periods=1).mean())
    return {(r.order_id, r.product_id): r.mean for r in rows[["order_id", "product_id", "mean"]].itertuples()}


def assert_close(got, want):
    assert got.keys() == want.keys()
    assert max(abs(got[key] - want[key]) for key in want) < 1e-9


@pytest.mark.parametrize("rows_per_slice", [5, 200, 1000, 10**6, None])
def test_blocks_equal_the_plain_window_for_a_hot_mode(spark, rows_per_slice):
    df = orders(spark)
    slices = rows_per_slice and rolling.day_slices(df, "order_date", "order_id", rows_per_slice)
    if slices:
        busiest = df.groupBy("order_date").count().agg(F.max("count")).first()[0]
        assert slices.agg(F.max("parts")).first()[0] == -(-busiest // rows_per_slice)
        assert slices.first().days == max(1, rows_per_slice // busiest)
    added = rolling.rolling(
        df, ["shipping_mode"], ORDER, 30, {"mean": lambda w: F.avg("lead_time").over(w)}, ["lead_time"], "all", slices
    )
    got = {(r.order_id, r.product_id): r["mean"] for r in added.collect()}
    assert added.columns == [*df.columns, "mean"]
    assert_close(got, expected(df, "shipping_mode", "lead_time"))


@pytest.mark.parametrize("min_rows", [1, 60, 10**9])
def test_any_choice_of_heavy_keys_gives_the_same_result(spark, min_rows):
    df = orders(spark, rows=2000)
    heavy = rolling.heavy_keys(df, ["customer_id"], min_rows)
    got = {(r.order_id, r.product_id): r.avg_order_value_30d for r in gold.rolling_customer(df, heavy).collect()}
    assert_close(got, expected(df, "customer_id", "sales"))


def test_sparse_blocks_reach_back_over_many_days(spark):
    """One row per day: every copy comes from a different earlier block."""
    df = orders(spark, rows=90, days=4000, seed=5)
    got = {(r.order_id, r.product_id): r.avg_lead_time_by_mode for r in gold.rolling_mode(df).collect()}
    assert_close(got, expected(df, "shipping_mode", "lead_time"))


def test_all_keys_with_enough_rows_are_heavy(spark):
    counts = {r.customer_id: r["count"] for r in orders(spark).groupBy("customer_id").count().collect()}
    got = {row[0] for row in rolling.heavy_keys(orders(spark), ["customer_id"], 60).collect()}
    assert got == {key for key, n in counts.items() if n >= 60}


def test_ids_that_ascend_with_the_date_are_cut_within_each_day(spark):
    df = spark.range(20000).select(F.col("id").alias("order_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 2000).cast("int")).alias("order_date"))
    slices = rolling.day_slices(df, "order_date", "order_id", 100)
    day = F.datediff("order_date", F.lit("1970-01-01").cast("date"))
    cut = df.join(slices, day == F.col("day"))
    block = F.expr("width_bucket(order_id, low, high + 1, parts)")
    assert cut.groupBy("order_date", block.alias("block")).count().agg(F.max("count")).first()[0] <= 200


def test_keep_first_breaks_ties_and_is_idempotent(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (2, None, "n"), (2, 1, "m"), (None, 1, "k")]
    df = spark.createDataFrame(rows, "k int, v int, t string")
    once = keep.keep_first(df, ["k"], [F.col("v").desc_nulls_last()])
    got = sorted(once.collect(), key=str)
    assert [(r.k, r.v, r.t) for r in got] and len(got) == 3
    assert {(r.k, r.v, r.t) for r in got} == {(1, 5, "b"), (2, 1, "m"), (None, 1, "k")}
    again = keep.keep_first(once, ["k"], [F.col("v").desc_nulls_last()])
    assert set(again.collect()) == set(once.collect())


def test_rank_filter_keeps_one_row_per_key_before_the_shuffle(spark):
    plan = keep.keep_first(orders(spark), ["customer_id"], [F.col("sales").desc()])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("WindowGroupLimit") == 2


def test_greatest_rows_equal_first_rows_and_a_count_of_them_sorts_nothing(spark):
    nan, columns = float("nan"), "k string, day date, n double, note string"
    days = [None, dt.date(2020, 1, 1), dt.date(2020, 1, 2)]
    rows = [(k, day, n, note) for k in ("a", None, "b") for day in days for n in (nan, None, 2.0, -1.0) for note in ("x", None, "y")]
    df = spark.createDataFrame(random.Random(5).sample(rows[:60], 60) + rows[:7], columns)
    found = keep.keep_greatest(df, ["k"], ["day"])
    assert found.schema == df.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, keep.keep_first(df, ["k"], [F.col("day").desc_nulls_last()]).collect()))
    plan = found.agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Sort", "Window", "max("))


def test_scope_falls_back_to_all_rows(spark):
    df = spark.createDataFrame([(2016, 1), (2017, 2), (2017, 3)], "year int, quarter int")
    assert keep.scoped_or_all(df, F.col("year") == 2017).count() == 2
    assert keep.scoped_or_all(df, F.col("year") == 2050).count() == 3


def test_side_by_side_needs_no_join(spark):
    a, b = spark.sql("SELECT 1 AS x, CAST(NULL AS INT) AS y"), spark.sql("SELECT 'q' AS z")
    joined = keep.side_by_side(a, b)
    assert tuple(joined.first()) == (1, None, "q")
    assert "Join" not in joined._jdf.queryExecution().executedPlan().toString()


def test_linked_department_fans_out_by_an_equi_join(spark):
    sales = spark.createDataFrame([(1, "Health and Beauty"), (2, "Fitness")], "order_id int, department string")
    stats = spark.createDataFrame([("haircare", 1.0), ("skincare", 2.0), ("cosmetics", 3.0), ("other", 9.0)], "product_type string, avg double")
    joined = joins.with_supplier_statistics(sales, stats)
    assert sorted((r.order_id, r.avg) for r in joined.collect() if r.avg) == [(1, 1.0), (1, 2.0), (1, 3.0)]
    assert joined.count() == 4
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def brute_cosine(queries, corpus, k):
    result = {}
    for qid, q in queries:
        scored = []
        for cid, c in corpus:
            norm = np.linalg.norm(q) * np.linalg.norm(c)
            scored.append((-round(float(np.dot(q, c) / norm) if norm else 0.0, 9), cid))
        result[qid] = [(cid, -score) for score, cid in sorted(scored)[:k]]
    return result


@pytest.mark.parametrize("per_block", [2, 1000])
def test_cosine_matches_brute_force(spark, monkeypatch, per_block):
    monkeypatch.setattr(nearest, "QUERIES_PER_BLOCK", per_block)
    monkeypatch.setattr(nearest, "ROWS_PER_BLOCK", 10 * per_block)
    random_ = np.random.default_rng(1)
    corpus = [(i, random_.normal(size=8).tolist()) for i in range(600)]
    corpus += [(1000 + i, corpus[i][1]) for i in range(200)] + [(5000, [0.0] * 8)]
    queries = [(f"q{i}", random_.normal(size=8).tolist()) for i in range(7)] + [("zero", [0.0] * 8)]
    got = nearest.cosine_top_k(
        spark.createDataFrame(queries, "query_id string, vector array<double>"),
        spark.createDataFrame(corpus, "id bigint, vector array<double>").repartition(5),
        4,
    )
    found = {}
    for row in got.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.id, row.score))
    want = brute_cosine([(q, np.array(v)) for q, v in queries], [(c, np.array(v)) for c, v in corpus], 4)
    assert {q: [i for i, _ in rows] for q, rows in found.items()} == {q: [i for i, _ in rows] for q, rows in want.items()}


@pytest.mark.parametrize("per_block", [3, 1000])
def test_keywords_match_brute_force(spark, monkeypatch, per_block):
    monkeypatch.setattr(nearest, "POSTINGS", 20 * per_block)  # the small one salts the frequent words
    pick = random.Random(2)
    vocabulary = ["the"] * 30 + [f"w{i}" for i in range(60)] + ["Été", "naïve_x", "42"]
    text = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n)) + ", THE!"
    corpus = [(i, text(pick.randrange(1, 40))) for i in range(700)] + [(900, ""), (901, "???"), (902, None)]
    queries = [(f"q{i}", text(6)) for i in range(8)] + [("none", "!!"), ("absent", "zebra"), ("null", None)]
    got = nearest.keyword_top_k(
        spark.createDataFrame(queries, "query_id string, text string"),
        spark.createDataFrame(corpus, "id bigint, text string").repartition(3),
        5,
    )
    import re

    tokens = lambda s: set(re.findall(r"\w+", (s or "").lower()))
    want = {}
    for qid, q in queries:
        size = len(tokens(q))
        scored = sorted((-round(len(tokens(q) & tokens(c)) / size, 9) if size else 0.0, i) for i, c in corpus)
        want[qid] = [(i, -score) for score, i in scored[:5]]
    found = {}
    for row in got.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.id, row.score))
    assert found == want


def test_search_keeps_queries_off_the_driver(spark):
    queries = spark.createDataFrame([("a", "one two"), ("b", "two three")], "query_id string, text string")
    corpus = spark.createDataFrame([(1, "one"), (2, "two three")], "id bigint, text string")
    plan = nearest.keyword_top_k(queries, corpus, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "salt" in plan  # posting lists meet query tokens in a join
    assert nearest.keyword_top_k(queries, corpus.limit(0), 2).count() == 0 == nearest.keyword_top_k(queries.limit(0), corpus, 2).count()
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, vector array<double>")
    assert nearest.cosine_top_k(vectors.withColumnRenamed("id", "query_id").limit(0), vectors).count() == 0


def test_keyword_search_moves_no_list_for_a_single_query(spark, monkeypatch):
    """Rows that share an id or a query_id count together, ids may be null or text; lists meet all queries of a salt at once."""
    monkeypatch.setattr(nearest, "POSTINGS", 4)
    monkeypatch.setattr(nearest, "QUERIES_PER_SALT", 2)
    corpus = [(f"d{i:02d}", " ".join(f"w{j}" for j in range(1, 8) if i % j == 0)) for i in range(20)] + [("d06", "w5 w7"), (None, "w1 w2 w3")]
    queries = [("a", "w2 w3"), ("b", "w5 w7 w4"), ("c", "w6"), ("twice", "w7"), ("twice", "w7"), (None, "w3 w4"), ("none", "x")]
    got = nearest.keyword_top_k(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(corpus, "id string, text string").repartition(3), 2)
    found = {}
    for row in got.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.id, row.score))
    third = round(1 / 3, 9)
    assert found == {
        "a": [("d00", 1.0), ("d06", 1.0)], "b": [("d00", 1.0), ("d06", 2 * third + 1e-9)], "c": [("d00", 1.0), ("d06", 1.0)],
        "twice": [("d00", 2.0), ("d06", 2.0)], None: [("d00", 1.0), ("d12", 1.0)], "none": [(None, 0.0), ("d00", 0.0)],
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_isolation_forest_ranks_outliers_first(spark):
    random_ = np.random.default_rng(4)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(random_.normal(size=(2000, 2)))]
    points += [(9000, 9.0, -9.0), (9001, -8.0, 8.5)]
    df = spark.createDataFrame(points, "id int, a double, b double").repartition(4)
    forest = isolation.grow(df, ["a", "b"], trees=40).toPandas()
    assert forest["tree"].nunique() == 40 and forest.groupby("tree").size().max() <= 2 * 256
    scored = isolation.score(df, ["a", "b"], forest)
    assert {9000, 9001} <= {row.id for row in scored.orderBy(F.col("isolation").desc()).limit(10).collect()}
    assert isinstance(forest, pd.DataFrame)


def test_exact_means_equal_moving_aggregates_and_add_up_no_frame(spark):
    """Nulls, ties in the frame's edge, a group without any value; decimals and whole numbers."""
    rows = [(i % 3, i, None if i % 3 == 2 or i % 7 == 0 else i * 13 % 50, f"{i * 37 % 1000}.{i % 100:02d}" if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at int, n int, text string").withColumn("d", F.col("text").cast("decimal(18,2)"))
    plain = {"a": lambda w: F.avg("n").over(w), "b": lambda w: measures.mean(F.col("d"), w), "c": lambda w: F.count(F.lit(1)).over(w)}
    exact = {"a": rolling.ExactMean("n"), "b": rolling.ExactMean("d"), "c": rolling.RowCount()}
    want, got = (rolling.rolling(df, ["k"], ["at"], 30, m, []) for m in (plain, exact))
    assert got.columns == want.columns and got.orderBy("at").collect() == want.orderBy("at").collect()
    assert "-29" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_moving_means_of_decimals_are_taken_from_running_sums(spark):
    df = orders(spark).withColumn("sales", F.col("sales").cast("decimal(18,2)"))
    plan = gold.rolling_mode(gold.rolling_customer(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -29" not in plan
