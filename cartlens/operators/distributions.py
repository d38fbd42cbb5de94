"""Counts, extremes and exact quantiles for several groupings in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.operators.numbering import in_ranges

def expand_scopes(df: DataFrame, scopes: dict[str, list[str]], dims: list[str]) -> DataFrame:
    """Repeat each row once per scope and blank the dimensions outside the scope."""
    members = [
        F.struct(
            F.lit(label).alias("scope"),
            *[
                (F.col(dim) if dim in kept else F.lit(None).cast(df.schema[dim].dataType)).alias(dim)
                for dim in dims
            ],
        )
        for label, kept in scopes.items()
    ]
    rest = [name for name in df.columns if name not in dims]
    exploded = df.select(F.explode(F.array(*members)).alias("_scope"), *rest)
    return exploded.select("_scope.*", *rest)


def value_counts(df: DataFrame, dims: list[str], ticks: Column) -> DataFrame:
    """(dims, _ticks, _n): how often each value occurs in each finest group."""
    return (
        df.select(*dims, ticks.cast("bigint").alias("_ticks"))
        .groupBy(*dims, "_ticks")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def scoped_distribution(
    df: DataFrame,
    scopes: dict[str, list[str]],
    ticks: Column,
    quantiles: dict[str, float],
    scratch: str | None = None,
) -> DataFrame:
    """Row count, value count, min, max and interpolated quantiles per scope.

    ``ticks`` is an integer value (cents, microseconds); NULL ticks are counted as
    rows only. The result has scope, the dimensions, rows, values, min_ticks,
    max_ticks and one double column per quantile, all still in ticks.
    """
    dims = list(dict.fromkeys(dim for kept in scopes.values() for dim in kept))
    counts = expand_scopes(value_counts(df, dims, ticks), scopes, dims)
    return counted_distribution(counts, ["scope", *dims], quantiles, scratch)


def counted_distribution(
    counts: DataFrame, keys: list[str], quantiles: dict[str, float], scratch: str | None = None
) -> DataFrame:
    """The same from value counts (keys, _ticks, _n), by selection from sorted ranges.

    The counts of all groups are written in one order (group, value), cut at sampled
    splitters. The totals of the ranges, one row for each group and range, tell in which
    range of its group each wanted rank lies, and only within that range are counts added
    up. So no task holds more than a range, however many values a group has, and all
    groups and ranks are found together.
    """
    whole = counts.groupBy(*keys, "_ticks").agg(F.sum("_n").alias("_n"))
    order = [*map(F.col, keys), F.col("_ticks").asc_nulls_last()]
    ranged = in_ranges(whole, order, "value-counts", scratch).drop("_seq")
    valued = F.when(F.col("_ticks").isNotNull(), F.col("_n"))
    ranges = ranged.groupBy(*keys, "_range").agg(
        F.sum("_n").alias("_rows"),
        F.coalesce(F.sum(valued), F.lit(0)).alias("_values"),
        F.min("_ticks").alias("_low"),
        F.max("_ticks").alias("_high"),
    )
    group = Window.partitionBy(*keys)
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    known = ranges.withColumns(
        {
            "rows": F.sum("_rows").over(group),
            "values": F.sum("_values").over(group),
            "min_ticks": F.min("_low").over(group),
            "max_ticks": F.max("_high").over(group),
            "_before": F.coalesce(F.sum("_values").over(ahead), F.lit(0)),
            "_first": F.row_number().over(group.orderBy("_range")) == 1,
        }
    )
    ranks = [
        rounding((F.col("values") - 1).cast("double") * F.lit(q)).cast("bigint")
        for q in quantiles.values()
        for rounding in (F.floor, F.ceil)
    ]
    upto = F.col("_before") + F.col("_values")
    here = [(rank >= F.col("_before")) & (rank < upto) for rank in ranks]
    # the ranges that hold a wanted rank; each group keeps its first range, so that none is lost
    wanted = known.where(F.col("_first") | reduce(lambda a, b: a | b, here))
    slots = [f"_rank{i}" for i in range(len(ranks))]
    summary = ["rows", "values", "min_ticks", "max_ticks"]
    named = [F.col(name).alias(f"_k_{name}") for name in keys]
    hits = wanted.select(
        *named, F.col("_range").alias("_r"), "_before", *summary,
        *[F.when(at, rank).alias(slot) for slot, rank, at in zip(slots, ranks, here)],
    )
    match = (F.col("_range") == F.col("_r")) & F.col("_ticks").isNotNull()
    for name in keys:
        match = match & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    marks = [f"_k_{name}" for name in keys]
    inside = Window.partitionBy(*marks, "_r").orderBy("_ticks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.join(ranged, match, "left").withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    within = [(F.col(slot) >= F.col("_upto") - F.col("_n")) & (F.col(slot) < F.col("_upto")) for slot in slots]
    found = placed.groupBy(*marks).agg(
        *[F.max(name).alias(name) for name in summary],
        *[F.max(F.when(at, F.col("_ticks"))).cast("double").alias(slot) for slot, at in zip(slots, within)],
    )
    columns = []
    for i, (name, q) in enumerate(quantiles.items()):
        low, high = F.col(slots[2 * i]), F.col(slots[2 * i + 1])
        at = (F.col("values") - 1).cast("double") * F.lit(q)
        columns.append((low + (high - low) * (at - F.floor(at).cast("double"))).alias(name))
    return found.select(*[F.col(f"_k_{name}").alias(name) for name in keys], *summary, *columns)
