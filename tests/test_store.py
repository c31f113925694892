import os

import pytest
from pyspark.sql import functions as F

from harborline.session import written
from harborline.sources import store


def files(path):
    """Data files of a stored table with their times and sizes, by folder."""
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                at = os.stat(os.path.join(folder, name))
                found.setdefault(os.path.relpath(folder, path), set()).add((name, at.st_mtime_ns, at.st_size))
    return found


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path, newest = str(tmp_path / "chunks"), [F.col("at").desc()]
    rows = spark.createDataFrame([(f"id{i}", i, f"old {i}") for i in range(200)], "id string, at int, text string")
    first = store.upsert(spark, path, rows, newest, buckets=16)
    assert first == list(range(16)) and spark.read.parquet(path).count() == 200
    before = files(path)
    again = [("id3", 500, "new 3"), ("id3", 400, "older"), ("id900", 1, "added"), ("id900", 1, "aa")]
    touched = store.upsert(spark, path, spark.createDataFrame(again, rows.schema), newest, buckets=16)
    after = files(path)
    assert 1 <= len(touched) <= 2
    assert {name for name in before if before[name] != after[name]} == {f"bucket={b}" for b in touched}
    found = {r.id: r.text for r in spark.read.parquet(path).collect()}
    assert len(found) == 201 and found["id3"] == "new 3" and found["id900"] == "added" and found["id4"] == "old 4"
    assert store.upsert(spark, path, rows.limit(0), newest, buckets=16) == [] and files(path) == after


def test_clearing_a_partition_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [(1, "a b/c"), (2, "en"), (3, "en"), (4, None), (5, "de")]
    spark.createDataFrame(rows, "id int, space string").write.partitionBy("space").parquet(path)
    before = files(path)
    assert store.clear_partition(spark, path, "space", "en") == 1 and store.clear_partition(spark, path, "space", "en") == 0
    assert files(path) == {name: found for name, found in before.items() if name != "space=en"}
    assert store.clear_partition(spark, path, "space", "a b/c") == 1 and store.clear_partition(spark, path, "space", None) == 1
    assert [r.id for r in spark.read.parquet(path).collect()] == [5]


@pytest.mark.parametrize("wanted", [0, 200])
def test_deleted_rows_go_from_their_partitions_only(spark, tmp_path, wanted):
    path = str(tmp_path / "rows")
    rows = [(1, 2020, 1, 0.0), (2, 2020, 1, 5.0), (3, 2020, 2, 0.0), (4, 2021, 1, 7.0), (5, 2021, 1, None), (6, 2021, 2, 200.0), (7, None, 1, 0.0), (8, None, 1, 1.0)]
    spark.createDataFrame(rows, "id int, year int, month int, value double").write.partitionBy("year", "month").parquet(path)
    before = files(path)
    changed = store.delete_rows(spark, path, F.col("value") == wanted, ["year", "month"])
    after = files(path)
    held = {0: 3, 200: 1}[wanted]
    assert changed == held and len([name for name in before if before[name] != after.get(name)]) == held
    assert {r.id for r in spark.read.parquet(path).collect()} == {i for i, _, _, value in rows if value != wanted}
    assert store.delete_rows(spark, path, F.col("value") == wanted, ["year", "month"]) == 0 and files(path) == after


def test_deleting_rows_writes_what_stays_once(spark, tmp_path, monkeypatch):
    path, stored = str(tmp_path / "rows"), []
    monkeypatch.setattr(store, "written", lambda df, name: stored.append(set(df.columns)) or written(df, name))
    rows = spark.range(100).selectExpr("id", "id % 10 AS part", "id % 7 AS value", "'wide' AS text")
    rows.write.partitionBy("part").parquet(path)
    assert store.delete_rows(spark, path, F.col("value") == 3, ["part"]) == 10
    assert {r.id for r in spark.read.parquet(path).collect()} == {i for i in range(100) if i % 7 != 3}
    assert stored and not any({"id", "text"} & columns for columns in stored)


def test_upsert_widens_the_rows_that_count_and_leaves_no_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS_PER_PART", 10)
    path, newest, folder = str(tmp_path / "chunks"), [F.col("at").desc()], spark.conf.get("spark.checkpoint.dir")
    rows = spark.range(400).selectExpr("concat('id', id % 300) AS id", "id AS at").unionByName(spark.sql("SELECT CAST(NULL AS string) AS id, 7L AS at"))
    wide = lambda kind: lambda df: df.select("id", F.concat(F.lit(kind), "at").alias("text"))
    assert store.upsert(spark, path, rows, newest, buckets=4, widen=wide("old ")) == [0, 1, 2, 3]
    assert store.upsert(spark, path, rows.where("at < 50"), newest, buckets=4, widen=wide("new ")) == [0, 1, 2, 3]
    found = [(r.id, r.text) for r in spark.read.parquet(path).collect()]
    want = {f"id{i}": f"new {i}" if i < 50 else f"old {i + 300 if i < 100 else i}" for i in range(300)}
    assert len(found) == 302 and {i: text for i, text in found if i is not None} == want
    assert sorted(text for i, text in found if i is None) == ["new 7", "old 7"]  # a null key equals no other
    assert not [r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("upsert_")]
    assert not [name for name in os.listdir(folder) if name.startswith("upsert_")]


def test_upsert_moves_wide_rows_without_a_shuffle(spark, tmp_path, monkeypatch):
    path, plans, replace = str(tmp_path / "chunks"), [], store._replace_partitions

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        replace(df, *rest)

    monkeypatch.setattr(store, "_replace_partitions", seen)
    rows = spark.range(200).selectExpr("concat('id', id) AS id", "id AS at", "repeat('x', 50) AS text")
    for part in (rows, rows.where("at < 150")):
        store.upsert(spark, path, part, [F.col("at").desc()], buckets=4)
    assert len(plans) == 2 and not any("Exchange" in plan for plan in plans) and spark.read.parquet(path).count() == 200
