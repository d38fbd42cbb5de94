"""Shares of totals and the sequential decomposition of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.measures import safe_ratio


def contribution_share(
    df: DataFrame, amount: str, name: str, partition: str | None = None
) -> DataFrame:
    """Share of the grand total, or of the total of a partition.

    Totals are partial aggregates that come back as a scalar or through an equi
    join, so the rows of one large partition never meet in one task.
    """
    if partition is None:
        total = df.select(F.sum(amount)).scalar()
        return df.withColumn(name, safe_ratio(F.col(amount), total))
    totals = df.groupBy(F.col(partition).alias("_part")).agg(F.sum(amount).alias("_total"))
    joined = df.join(totals, F.col(partition).eqNullSafe(F.col("_part")), "left")
    return joined.withColumn(name, safe_ratio(F.col(amount), F.col("_total"))).drop(
        "_part", "_total"
    )


def sequential_decomposition(
    periods: DataFrame, period: str, count: str, amount: str, average: str, change: str, names: dict
) -> DataFrame:
    """Split a change of amount into a count part and an average part, in this order.

    ``periods`` holds one row per period without gaps, so the ordered window is as
    small as the calendar. ``names`` maps previous_amount, previous_count,
    previous_average, rate, count_part, average_part and residual to column names.
    """
    steps = Window.orderBy(period)
    n1, a1, v1 = F.col(count), F.col(average), F.col(amount)
    n0, a0, v0 = (F.col(names[f"previous_{x}"]) for x in ("count", "average", "amount"))
    before = periods.withColumns(
        {
            names["previous_amount"]: F.lag(amount).over(steps),
            names["previous_count"]: F.lag(count).over(steps),
            names["previous_average"]: F.lag(average).over(steps),
        }
    )
    parts = before.withColumns(
        {
            change: v1 - v0,
            names["rate"]: safe_ratio(v1 - v0, v0),
            names["count_part"]: (n1 - n0).cast("double") * a0,
            names["average_part"]: n1.cast("double") * (a1 - a0),
        }
    )
    residual = (
        F.col(change).cast("double") - F.col(names["count_part"]) - F.col(names["average_part"])
    )
    return parts.withColumn(names["residual"], residual)
