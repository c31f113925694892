import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.sources import files, tables


def test_csv_stays_text_until_silver(spark, tmp_path):
    (tmp_path / "Inventory_Stock_Data.csv").write_text("product id,avg lead time,current stock\n19,10,69\n24,?,175\n")
    raw = files.read_csv_as_text(spark, str(tmp_path / "Inventory_Stock_Data.csv"))
    assert {f.dataType for f in raw.schema.fields} == {T.StringType()} and raw.count() == 2
    loaded = tables.load_bronze(spark, str(tmp_path), root=str(tmp_path / "bronze"))
    assert loaded == ["bronze_inventory_stock_data"]
    assert spark.table(loaded[0]).columns == ["product id", "avg lead time", "current stock"]
    tables.rename_table(spark, loaded[0], "bronze_renamed")
    names = [r.tableName for r in tables.list_tables(spark).collect()]
    assert "bronze_renamed" in names and loaded[0] not in names


def test_typed_csv_matches_columns_by_name(spark, tmp_path):
    (tmp_path / "gold.csv").write_text("b,a,extra\nx,1.5,9\ny,bad,9\n")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType()), T.StructField("absent", T.LongType())])
    assert [tuple(r) for r in files.read_typed_csv(spark, str(tmp_path / "gold.csv"), schema).collect()] == [(1.5, "x"), (None, "y")]


def test_only_text_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line 1\nline 2")
    (tmp_path / "b.md").write_text("# b")
    (tmp_path / "c.pdf").write_text("no")
    got = {r.source: r.content for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "line 1\nline 2", "b.md": "# b"}


def test_delete_keeps_rows_where_the_condition_is_null(spark):
    df = spark.createDataFrame([(200.0,), (199.0,), (None,)], "avg_order_value_30d double")
    assert tables.without_rows(df, F.col("avg_order_value_30d") == 200).count() == 2


def test_counts_and_status(spark):
    a = spark.createDataFrame([(dt.date(2018, 1, 1),), (None,)], "order_date date")
    counts = tables.row_counts({"gold": {"a": a}, "raw": {"b": a.limit(0)}})
    assert {tuple(r) for r in counts.collect()} == {("gold", "a", 2), ("raw", "b", 0)}
    assert tuple(tables.status(a).first()) == (1, dt.date(2018, 1, 1))


def test_month_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "by-month")
    days = spark.sql("SELECT id, date_add(date'2018-01-01', CAST(id % 90 AS INT)) AS order_date FROM range(900)")
    files.write_partitioned(days, path)
    back = spark.read.parquet(path)
    march = back.filter("part_year = 2018 AND part_month = 3")
    assert back.count() == 900 and march.count() == 310
    assert "PartitionFilters: [isnotnull" in march._jdf.queryExecution().executedPlan().toString()


def test_identifiers_are_checked():
    assert tables.table_name("main", "default", "t1") == "main.default.t1"
    for bad in ("a b", "x;drop", "1a", ""):
        try:
            tables.table_name(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
