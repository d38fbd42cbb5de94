"""Zone-free time expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def month_of(ts: Column) -> Column:
    """First day of the month as a date (date_trunc would return a zoned timestamp)."""
    return F.trunc(ts.cast("date"), "MM")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def days_from_micros(micros: Column) -> Column:
    return micros.cast("double") / F.lit(1e6) / F.lit(86400.0)


def fractional_days(start: Column, end: Column) -> Column:
    return days_from_micros(micros_between(start, end))


def plus_days(ts: Column, days: int | Column) -> Column:
    return ts + F.make_dt_interval(days if isinstance(days, Column) else F.lit(days))


def ntz_literal(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def first_of_month(value: dt.date) -> dt.date:
    return value.replace(day=1)


def month_sequence(start: dt.date, end: dt.date) -> Column:
    """Every month that the closed date range touches, as an array of first days."""
    return F.sequence(
        F.lit(first_of_month(start)),
        F.lit(first_of_month(end)),
        F.expr("interval 1 month"),
    )


def covers_whole_month(month: Column, start: dt.date, end: dt.date) -> Column:
    return (F.lit(start) <= month) & (F.lit(end) >= F.last_day(month))
