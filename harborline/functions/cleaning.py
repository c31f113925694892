"""Cleaning of string-typed source columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted timestamp layouts (tried in order before the default parse), the placeholder that
# means "no date", and the delivery-status words that mean "late".
DATE_FORMATS = ("M/d/yyyy H:mm", "yyyy-MM-dd H:mm:ss")
NO_DATE = "-"
DASHED = r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}$"
LATE_WORDS = ("late delivery", "late", "yes", "1", "true")
UNKNOWN = "Unknown"
NO_CUSTOMER = -1


def parse_date(text: Column, no_date: str | None = NO_DATE) -> Column:
    """Date of the first layout that fits; NULL for the placeholder and for anything unreadable.

    A layout is tried only on text of its shape: a failed attempt raises inside the parser, which is far slower
    than the pattern test. The default parse comes last and never raises.
    """
    slashes, dashes = DATE_FORMATS
    attempts = [
        F.when(text.contains("/"), F.try_to_timestamp(text, F.lit(slashes))),
        F.when(text.rlike(DASHED), F.try_to_timestamp(text, F.lit(dashes))),
        F.try_to_timestamp(text),
    ]
    parsed = F.coalesce(*(F.to_date(attempt) for attempt in attempts))
    return parsed if no_date is None else F.when(text == no_date, None).otherwise(parsed)


def number_or_zero(text: Column, type_name: str) -> Column:
    return F.coalesce(text.try_cast(type_name), F.lit(0).cast(type_name))


def text_or_unknown(text: Column) -> Column:
    return F.coalesce(text, F.lit(UNKNOWN))


def customer_or_none(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(NO_CUSTOMER).cast("bigint"))


def late_flag(status: Column) -> Column:
    return F.when(F.lower(F.trim(status)).isin(*LATE_WORDS), 1).otherwise(0)
