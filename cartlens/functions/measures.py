"""Aggregate and ratio expressions that keep NULL, zero and "not applicable" apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; an empty denominator gives NULL, never zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def guarded_sum(amount: Column, non_negative: bool = True) -> Column:
    """Sum that is NULL unless every row of the group carries a usable amount."""
    complete = F.count(amount) == F.count(F.lit(1))
    if non_negative:
        complete = complete & F.bool_and(amount >= 0)
    return F.when(complete, F.sum(amount))


def guarded_sum_where(condition: Column, amount: Column) -> Column:
    """Guarded sum over the rows that satisfy a condition; no such row gives zero."""
    chosen = F.when(condition, amount)
    return F.when(
        F.count_if(condition) == F.count(chosen),
        F.coalesce(F.sum(chosen), F.lit(0).cast("decimal(18,2)")),
    )


def is_true(condition: Column) -> Column:
    """Two-valued flag: an unknown condition counts as false."""
    return F.coalesce(condition, F.lit(False))


def is_not_true(condition: Column) -> Column:
    """Keeps false and unknown rows."""
    return ~condition.eqNullSafe(F.lit(True))


def sign_of_gap(gap: Column, tolerance: float = 1e-12) -> Column:
    """1, -1 or 0 with a tolerance for floating-point noise."""
    return F.when(gap > tolerance, 1).when(gap < -tolerance, -1).when(gap.isNotNull(), 0)
