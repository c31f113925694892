"""Text forms of numbers. Rounding happens on decimals, ties away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Fixed number of decimals, no grouping: 12.345 -> '12.3' for one digit."""
    return F.round(value.cast("decimal(28,10)"), digits).cast(f"decimal(28,{digits})").cast("string")


def grouped(value: Column, digits: int = 0) -> Column:
    """Thousands separators: 1234.5 -> '1,234.50' for two digits."""
    return F.format_number(F.round(value.cast("decimal(28,10)"), digits).cast(f"decimal(28,{digits})"), digits)


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed(F.coalesce(value, F.lit(0.0)), digits), F.lit("%"))


def money_text(value: Column) -> Column:
    return F.concat(F.lit("$"), grouped(F.coalesce(value.cast("double"), F.lit(0.0)), 2))


def whole(value: Column) -> Column:
    """Nearest whole number, ties to even; NULL becomes 0."""
    return F.bround(F.coalesce(value.cast("double"), F.lit(0.0)), 0).cast("bigint")


def plain(value: Column) -> Column:
    """Up to four decimals with trailing zeros removed; '12.5000' -> '12.5', '3.0000' -> '3'."""
    return F.rtrim(F.rtrim(fixed(value, 4), F.lit("0")), F.lit("."))
