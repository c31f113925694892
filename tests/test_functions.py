import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.functions import bands, cleaning, display, measures, months


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1/31/2018 22:56", dt.date(2018, 1, 31)),
        ("12/1/2017 5:07", dt.date(2017, 12, 1)),
        ("2018-01-31 22:56:00", dt.date(2018, 1, 31)),
        ("2018-01-31 5:06:07", dt.date(2018, 1, 31)),
        ("2018-01-31", dt.date(2018, 1, 31)),
        ("13/45/2018 22:56", None),
        ("-", None),
        ("n/a", None),
        (None, None),
    ],
)
def test_parse_date(one, text, expected):
    assert one(cleaning.parse_date(F.lit(text).cast("string"))) == expected


def test_numbers_default_to_zero(one):
    assert one(cleaning.number_or_zero(F.lit("abc"), "double")) == 0.0
    assert one(cleaning.number_or_zero(F.lit("12.5"), "int")) == 0
    assert one(cleaning.number_or_zero(F.lit("12.5"), "double")) == 12.5
    assert one(cleaning.customer_or_none(F.lit("x1"))) == -1
    assert one(cleaning.text_or_unknown(F.lit(None).cast("string"))) == "Unknown"


@pytest.mark.parametrize("status, flag", [(" Late Delivery ", 1), ("YES", 1), ("1", 1), ("true", 1), ("on time", 0), (None, 0)])
def test_late_flag(one, status, flag):
    assert one(cleaning.late_flag(F.lit(status).cast("string"))) == flag


@pytest.mark.parametrize(
    "stock, point, expected",
    [
        (79, 100, "Critical"),
        (80, 100, "Low"),
        (99, 100, "Low"),
        (100, 100, "Healthy"),
        (200, 100, "Healthy"),
        (201, 100, "Overstock"),
        (5, 0, "Healthy"),
    ],
)
def test_stock_status(one, stock, point, expected):
    assert one(bands.stock_status(F.lit(stock), F.lit(point))) == expected


@pytest.mark.parametrize("score, expected", [(24.99, "Low"), (25.0, "Medium"), (60.0, "Medium"), (60.01, "High"), (None, "Unknown")])
def test_risk_category(one, score, expected):
    assert one(bands.risk_category(F.lit(score).cast("double"))) == expected


def test_grades_and_exposure(one):
    assert one(bands.grade(F.lit(30.0), 30, 15, True)) == "High"
    assert one(bands.grade(F.lit(50), 50, 0)) == "Medium"
    assert one(bands.grade(F.lit(0), 50, 0)) == "Low"
    assert [one(bands.exposure_band(F.lit(value))) for value in (61, 60, 46, 45)] == ["high", "warning", "warning", "normal"]
    assert one(bands.demand_risk(F.lit(126.0), F.lit(100.0))) == "High"
    assert one(bands.demand_risk(F.lit(111.0), F.lit(100.0))) == "Medium"
    assert one(bands.demand_risk(F.lit(108.0), F.lit(100.0))) == "Low"


def test_display(one):
    assert one(display.percent_text(F.lit(12.345))) == "12.3%"
    assert one(display.percent_text(F.lit(None).cast("double"))) == "0.0%"
    assert one(display.money_text(F.lit(1234.5))) == "$1,234.50"
    assert [one(display.whole(F.lit(value))) for value in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]
    assert [one(display.plain(F.lit(value))) for value in (12.5, 3.0, 100.0, 0.0, 0.12345, -1.25)] == [
        "12.5",
        "3",
        "100",
        "0",
        "0.1235",
        "-1.25",
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("dec-2017", dt.date(2017, 12, 1)),
        ("December-2017", dt.date(2017, 12, 1)),
        ("DEC 2017", dt.date(2017, 12, 1)),
        ("december 2017", dt.date(2017, 12, 1)),
        ("2017-3", dt.date(2017, 3, 1)),
        ("2017/03", dt.date(2017, 3, 1)),
        ("mar_2017", dt.date(2017, 3, 1)),
        ("2017-13", None),
        ("all", None),
        ("", None),
    ],
)
def test_month_ids(one, text, expected):
    assert months.month_start(text) == expected
    assert one(months.month_start_column(F.lit(text))) == expected


def test_month_range_rolls_over_the_year(spark):
    days = spark.sql("SELECT explode(sequence(date'2017-11-30', date'2018-01-02')) AS d")
    held = days.filter(months.in_month(F.col("d"), "dec-2017")).agg(F.min("d"), F.max("d"), F.count("d")).first()
    assert tuple(held) == (dt.date(2017, 12, 1), dt.date(2017, 12, 31), 31)
    assert days.filter(months.in_month(F.col("d"), "whenever")).count() == days.count()
    assert months.date_column("jan-2024") == "date" and months.date_column("dec-2023") == "order_date"
    assert months.date_column(None) == "order_date"


def test_number_or_default(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    got = [row[0] for row in df.select(measures.number_or_default(df, "v", 7.0)).collect()]
    assert got == [1.5, 7.0, 7.0, 7.0]
    assert df.select(measures.number_or_default(df, "missing", 2.0)).first()[0] == 2.0


def test_at_risk_needs_a_slower_lead_time(spark):
    rows = [(1, 10, 9.0), (1, 10, 10.0), (1, 10, None), (1, None, None), (0, 10, 1.0), (None, 10, 1.0)]
    df = spark.createDataFrame(rows, "is_late_delivery int, lead_time int, avg_lead_time_by_mode double")
    assert [row[0] for row in df.select(measures.is_at_risk()).collect()] == [True, False, False, False, False, False]
