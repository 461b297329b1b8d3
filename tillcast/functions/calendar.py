"""Date features and date-range rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def is_weekend(date: Column) -> Column:
    """Saturday or Sunday (``weekday`` counts from Monday = 0)."""
    return F.weekday(date) >= 5


def day_of_month(date: Column) -> Column:
    return F.dayofmonth(date)


def week_bounds(date: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the week holding ``date``."""
    monday = F.date_trunc("week", date).cast("date")
    return monday, F.date_add(monday, 6)


def month_bounds(date: Column) -> tuple[Column, Column]:
    """First and last day of the month holding ``date``."""
    return F.trunc(date, "MM"), F.last_day(date)


def clamp_start(start: Column, end: Column, max_days: int = 60, months: int = 2) -> Column:
    """Start of a range, moved to ``months`` before its end when it spans too many days."""
    return F.when(F.datediff(end, start) > max_days, F.add_months(end, -months)).otherwise(start)
