"""Exact aggregates over all order records that answer the usual questions, as tables and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.display import fixed, grouped, plain
from harborline.functions.measures import mean
from harborline.operators.keep import ranked_top, scoped_or_all


def in_scope(records: DataFrame, year: int | None = None, quarter: int | None = None) -> DataFrame:
    """Records of a year and/or quarter; all records when that scope holds none."""
    if year is None and quarter is None:
        return records
    condition = F.lit(True)
    if year is not None:
        condition &= F.col("year") == year
    if quarter is not None:
        condition &= F.col("quarter") == quarter
    return scoped_or_all(records, condition)


def _orders() -> Column:
    return F.countDistinct("order_id")


def _money(name: str) -> Column:
    return F.sum(name).cast("double")


def product_sales_rank(records: DataFrame, n: int = 5) -> DataFrame:
    """The first row of each order and product counts the order: a sort of narrow rows, where a distinct count holds all pairs in hash tables."""
    first = F.row_number().over(Window.partitionBy("order_id", "product_id").orderBy("sales")) == 1
    marked = records.select("product_id", "order_id", "sales", "profit").withColumn("first", first & F.col("order_id").isNotNull())
    grouped_rows = marked.groupBy("product_id").agg(
        _money("sales").alias("total_sales"), _money("profit").alias("total_profit"), F.count_if("first").alias("orders")
    )
    return ranked_top(grouped_rows, [F.col("total_sales").desc(), F.col("product_id")], n)


def department_shipping_cost(records: DataFrame, n: int = 5) -> DataFrame:
    grouped_rows = records.groupBy("department").agg(
        F.avg("avg_shipping_cost").alias("average_shipping_cost"), _orders().alias("orders")
    )
    return ranked_top(grouped_rows, [F.col("average_shipping_cost").desc(), F.col("department")], n)


def sales_profit_by_quarter(records: DataFrame) -> DataFrame:
    return (
        records.groupBy("year", "quarter")
        .agg(_money("sales").alias("total_sales"), _money("profit").alias("total_profit"), _orders().alias("orders"))
        .orderBy("year", "quarter")
    )


def unprofitable_bulk_orders(records: DataFrame) -> DataFrame:
    return records.filter((F.col("is_bulk_order") == 1) & (F.col("is_profitable") == 0))


def lowest_profit_bulk_orders(records: DataFrame, n: int = 10) -> DataFrame:
    order = [F.col("profit"), F.col("sales"), F.col("order_id"), F.col("product_id")]
    picked = unprofitable_bulk_orders(records).select(
        "order_id", "product_id", "quantity", "sales", "profit", "profit_margin"
    )
    return ranked_top(picked, order, n)


def late_orders(records: DataFrame) -> DataFrame:
    return records.filter(F.col("is_late_delivery") == 1)


def late_by_market_department(records: DataFrame, n: int = 10) -> DataFrame:
    grouped_rows = (
        late_orders(records)
        .groupBy("market", "department")
        .agg(_orders().alias("late_orders"), mean(F.col("lead_time")).alias("average_lead_time"))
    )
    return ranked_top(grouped_rows, [F.col("late_orders").desc(), F.col("market"), F.col("department")], n)


def lead_time_by_mode(records: DataFrame, n: int = 10) -> DataFrame:
    grouped_rows = records.groupBy("shipping_mode").agg(
        mean(F.col("lead_time")).alias("average_lead_time"), _orders().alias("orders")
    )
    return ranked_top(grouped_rows, [F.col("average_lead_time").desc(), F.col("shipping_mode")], n)


def longest_lead_orders(records: DataFrame, n: int = 5) -> DataFrame:
    order = [F.col("lead_time").desc(), F.col("order_id"), F.col("product_id")]
    return ranked_top(records.select("order_id", "product_id", "lead_time", "shipping_mode"), order, n)


def largest_quantity_orders(records: DataFrame, n: int = 5) -> DataFrame:
    order = [F.col("quantity").desc(), F.col("order_id"), F.col("product_id"), F.col("sales")]
    return ranked_top(records.select("order_id", "product_id", "quantity", "sales"), order, n)


def order_lookup(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Details of the wanted orders (a frame of order_id), however many they are."""
    details = ["order_id", "product_id", "order_date", "shipment_date", "sales", "quantity", "profit", "shipping_mode"]
    return records.select(*details, "lead_time", "is_late_delivery").join(
        wanted.select("order_id").distinct(), "order_id", "left_semi"
    )


def _numbered(text: Column) -> Column:
    return F.concat(F.col("rank").cast("string"), F.lit(". "), text)


def _join(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(part) if isinstance(part, str) else part for part in parts))


def _dollars(name: str) -> Column:
    return _join("$", grouped(F.col(name), 2))


def _count(name: str) -> Column:
    return grouped(F.col(name))


# What stands for {scope} in a heading, for all records and for a part of them.
ALL_ROWS = "all {rows} available order rows"
SOME_ROWS = "the requested time period ({rows} order rows)"


def _filled(template: str, values: dict[str, Column]) -> Column:
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def _heading_values(records: DataFrame, whole: DataFrame | None) -> dict[str, Column]:
    """Counts that headings mention, as text: one pass over the records, shared by all headings."""
    unprofitable = (F.col("is_bulk_order") == 1) & (F.col("is_profitable") == 0)
    counted = records.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(unprofitable).alias("bulk"),
            F.count_if(F.col("is_late_delivery") == 1).alias("late"),
        )
    ).scalar()
    rows = counted.getField("rows")
    scope = _filled(ALL_ROWS, {"rows": grouped(rows)})
    if whole is not None:
        every = whole.agg(F.count(F.lit(1))).scalar()
        scope = F.when(rows == every, scope).otherwise(_filled(SOME_ROWS, {"rows": grouped(rows)}))
    return {"scope": scope, "bulk": grouped(counted.getField("bulk")), "late": grouped(counted.getField("late"))}


def _document(lines: DataFrame, source: str, heading: Column) -> DataFrame:
    """One text from (rank, line) rows of a short report: the heading, then its lines in order."""
    ordered = F.transform(F.sort_array("entries"), lambda entry: entry["line"])
    body = F.array_join(F.concat(F.array(heading), ordered), "\n")
    packed = lines.agg(F.collect_list(F.struct("rank", "line")).alias("entries"))
    return packed.select(body.alias("content"), F.lit(source).alias("source"), F.lit(1.0).alias("similarity"))


def answer_documents(records: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """The eight reports as texts (content, source, similarity) over all given records.

    Headings tell how many rows were read; with ``whole`` given, whether ``records`` are all of them or a part. Sources,
    headings and line forms are fixed values that existing consumers show as they are.
    """
    values = _heading_values(records, whole)
    by_quarter = sales_profit_by_quarter(records).withColumn("rank", F.col("year") * 10 + F.col("quarter"))
    parts = [
        (
            product_sales_rank(records),
            _numbered(
                _join("Product ID ", F.col("product_id"), ": total sales ", _dollars("total_sales"), "; total profit ",
                      _dollars("total_profit"), "; ", _count("orders"), " orders.")
            ),
            "Full-dataset product-sales calculation",
            "Exact product-sales ranking calculated from {scope}:",
        ),
        (
            department_shipping_cost(records),
            _numbered(
                _join(F.col("department"), ": average shipping cost ", _dollars("average_shipping_cost"), " across ",
                      _count("orders"), " orders.")
            ),
            "Full-dataset department shipping-cost calculation",
            "Exact department shipping-cost ranking calculated from {scope}:",
        ),
        (
            by_quarter,
            _join("Year ", F.col("year"), ", Q", F.col("quarter"), ": total sales ", _dollars("total_sales"),
                  "; total profit ", _dollars("total_profit"), "; ", _count("orders"), " orders."),
            "Full-dataset sales and profit comparison",
            "Exact sales and profit comparison calculated from {scope}:",
        ),
        (
            lowest_profit_bulk_orders(records),
            _join("Order ", F.col("order_id"), ": product ID ", F.col("product_id"), "; quantity ",
                  plain(F.col("quantity")), "; sales ", _dollars("sales"), "; profit ", _dollars("profit"),
                  "; profit margin ", fixed(F.col("profit_margin") * 100, 2), "%."),
            "Full-dataset unprofitable bulk-order calculation",
            "Exact bulk-order profitability result from {scope}: {bulk} bulk orders are not profitable.\nThe following are the 10 lowest-profit orders:",
        ),
        (
            late_by_market_department(records),
            _join(F.col("market"), " / ", F.col("department"), ": ", _count("late_orders"),
                  " late orders; average lead time ", fixed(F.col("average_lead_time"), 2), " days."),
            "Full-dataset late-order calculation",
            "Exact late-order overview calculated from {scope}: {late} late orders.",
        ),
        (
            lead_time_by_mode(records),
            _join(F.col("shipping_mode"), ": average lead time ", fixed(F.col("average_lead_time"), 2),
                  " days across ", _count("orders"), " orders."),
            "Full-dataset shipping-mode lead-time calculation",
            "Exact shipping-mode lead-time comparison calculated from {scope}:",
        ),
        (
            longest_lead_orders(records),
            _join("Order ", F.col("order_id"), ": lead time ", plain(F.col("lead_time")), " days; product ID ",
                  F.col("product_id"), "; shipping mode ", F.col("shipping_mode"), "."),
            "Full-dataset lead-time calculation",
            "Exact longest-lead-time orders from {scope}:",
        ),
        (
            largest_quantity_orders(records),
            _join("Order ", F.col("order_id"), ": quantity ", plain(F.col("quantity")), "; sales ", _dollars("sales"),
                  "; product ID ", F.col("product_id"), "."),
            "Full-dataset quantity calculation",
            "Exact largest-quantity orders from {scope}:",
        ),
    ]
    result = None
    for rows, line, source, heading in parts:
        document = _document(rows.select(F.col("rank").cast("int").alias("rank"), line.alias("line")), source, _filled(heading, values))
        result = document if result is None else result.unionByName(document)
    return result
