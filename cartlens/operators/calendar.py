"""Calendar relations built from literals: no table is read and nothing is joined."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.functions.time import month_sequence


def month_spine(
    spark: SparkSession, start: dt.date, end: dt.date, name: str = "purchase_month"
) -> DataFrame:
    """One row per calendar month touched by the closed range."""
    return spark.range(1).select(F.explode(month_sequence(start, end)).alias(name))


def day_spine(spark: SparkSession, start: dt.date, end: dt.date, name: str = "date") -> DataFrame:
    """One row per day of the closed range."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(name))


def with_calendar_parts(days: DataFrame, name: str = "date") -> DataFrame:
    day = F.col(name)
    return days.select(
        day,
        F.trunc(day, "MM").alias("month_start"),
        F.year(day).cast("bigint").alias("year"),
        F.quarter(day).cast("bigint").alias("quarter"),
        F.month(day).cast("bigint").alias("month"),
    )


def fill_spine(spine: DataFrame, grouped: DataFrame, keys: list[str], zeros: list[str]) -> DataFrame:
    """Left join of already aggregated rows onto a spine; named counters become 0.

    Aggregating first keeps the join at group size instead of row size.
    """
    joined = spine.join(grouped, keys, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in zeros})


def dense_grid(members: DataFrame, axes: dict) -> DataFrame:
    """All combinations of the member rows with literal arrays, one explode per axis.

    The axes are literals, so the grid is a projection: there is no cross join.
    """
    grid = members
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(values))
    return grid
