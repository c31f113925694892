"""Month ids such as ``mar-2017`` and the date ranges they stand for."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts accepted for a month id (after '/' and '_' have become '-') and the first year whose
# rows are dated by ``date`` instead of ``order_date``.
ID_LAYOUTS = ("MMM-yyyy", "MMMM-yyyy", "MMM yyyy", "MMMM yyyy", "yyyy-M")
DATE_COLUMN_SINCE = 2024

_MONTHS = {
    name.lower(): number
    for names in (calendar.month_abbr, calendar.month_name)
    for number, name in enumerate(names)
    if name
}


def month_start(month_id: str | None) -> dt.date | None:
    """First day of the month an id names, or None when the id is not one."""
    text = re.sub(r"[/_]", "-", (month_id or "").strip().lower())
    if found := re.fullmatch(r"([a-z]+)[- ](\d{4})", text):
        month, year = _MONTHS.get(found[1]), int(found[2])
    elif found := re.fullmatch(r"(\d{4})-(\d{1,2})", text):
        year, month = int(found[1]), int(found[2])
    else:
        return None
    return dt.date(year, month, 1) if month and 1 <= month <= 12 else None


def month_start_column(month_id: Column) -> Column:
    """Column form of :func:`month_start`."""
    text = F.regexp_replace(F.lower(F.trim(month_id)), "[/_]", "-")
    return F.trunc(F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(form))) for form in ID_LAYOUTS)), "month")


def in_month(day: Column, month_id: str | None) -> Column:
    """Half-open range predicate that reaches the Parquet scan; always true for an id that is not one."""
    first = month_start(month_id)
    if first is None:
        return F.lit(True)
    following = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return (day >= F.lit(first)) & (day < F.lit(following))


def date_column(month_id: str | None) -> str:
    first = month_start(month_id)
    return "date" if first is not None and first.year >= DATE_COLUMN_SINCE else "order_date"


def month_key(day: Column) -> Column:
    return F.lower(F.date_format(F.trunc(day, "month"), "MMM-yyyy"))


def month_label(day: Column) -> Column:
    return F.date_format(F.trunc(day, "month"), "MMMM yyyy")


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.trunc(day, "week")
