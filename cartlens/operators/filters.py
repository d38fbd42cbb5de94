"""Reusable row selections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.time import first_of_month, ntz_literal


def within_days(ts: Column, start: dt.date, end: dt.date) -> Column:
    """Inclusive day range written as a timestamp range, so that Parquet can skip row groups."""
    low = dt.datetime.combine(start, dt.time())
    high = dt.datetime.combine(end + dt.timedelta(days=1), dt.time())
    return (ts >= ntz_literal(low)) & (ts < ntz_literal(high))


def window_filter(
    df: DataFrame, date_column: str, start: dt.date, end: dt.date, month_column: str | None = None
) -> DataFrame:
    """Inclusive window on a date column; a month partition column is pruned as well."""
    kept = df.filter(F.col(date_column).between(F.lit(start), F.lit(end)))
    if month_column is not None:
        kept = kept.filter(
            F.col(month_column).between(F.lit(first_of_month(start)), F.lit(first_of_month(end)))
        )
    return kept


def observed_until(df: DataFrame, ts_column: str, entity: str, cutoff: dt.datetime) -> DataFrame:
    """Known entity, known time, not after the cut-off; the window start is not applied."""
    ts = F.col(ts_column)
    return df.filter(ts.isNotNull() & F.col(entity).isNotNull() & (ts <= ntz_literal(cutoff)))
