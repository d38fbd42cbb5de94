"""Overlapping samples of the same rows and stratified comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.measures import safe_ratio, sign_of_gap


def sample_expand(df: DataFrame, samples: dict[str, Column], name: str = "sample") -> DataFrame:
    """One output row per input row and sample it belongs to."""
    labels = F.array(*[F.when(member, F.lit(label)) for label, member in samples.items()])
    return df.withColumn(name, F.explode(F.filter(labels, lambda label: label.isNotNull())))


def sample_counts(
    df: DataFrame, by: list[str], samples: dict[str, Column], measures: dict[str, Column]
) -> DataFrame:
    """Counts per group and sample from one pass over unrepeated rows.

    The samples become conditional counters of one aggregate and turn into rows
    only after the aggregation, so overlapping samples do not multiply the input.
    """
    counters = [
        F.count_if(member & condition).alias(f"_{i}_{name}")
        for i, member in enumerate(samples.values())
        for name, condition in measures.items()
    ]
    wide = df.groupBy(*by).agg(*counters)
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("sample"),
                *[F.col(f"_{i}_{name}").alias(name) for name in measures],
            )
            for i, label in enumerate(samples)
        ]
    )
    return wide.select(*by, F.explode(rows).alias("_row")).select(*by, "_row.*")


def with_group_gap(
    counts: DataFrame,
    base: tuple[str, str],
    other: tuple[str, str],
    min_rows: int,
    names: dict[str, str],
) -> DataFrame:
    """Outcome shares of two groups, their difference, and the sample-size flag.

    ``base`` and ``other`` are (rows, outcomes) column pairs; ``names`` maps
    base_share, other_share, gap and threshold to output names.
    """
    base_share = safe_ratio(F.col(base[1]), F.col(base[0]))
    other_share = safe_ratio(F.col(other[1]), F.col(other[0]))
    enough = (F.col(base[0]) >= min_rows) & (F.col(other[0]) >= min_rows)
    return counts.withColumns(
        {
            names["base_share"]: base_share,
            names["other_share"]: other_share,
            names["gap"]: other_share - base_share,
            names["threshold"]: enough,
        }
    )


def stratified_gap(
    df: DataFrame,
    strata: list[str],
    group: Column,
    outcome: Column,
    samples: dict[str, Column],
    min_rows: int,
) -> DataFrame:
    """Per stratum and sample: outcome share where ``group`` holds against where it does not."""
    counts = sample_counts(
        df,
        strata,
        samples,
        {
            "base_rows": ~group,
            "other_rows": group,
            "base_outcomes": ~group & outcome,
            "other_outcomes": group & outcome,
        },
    )
    return with_group_gap(
        counts,
        ("base_rows", "base_outcomes"),
        ("other_rows", "other_outcomes"),
        min_rows,
        {
            "base_share": "base_share",
            "other_share": "other_share",
            "gap": "gap",
            "threshold": "meets_threshold",
        },
    )


def gap_signs(
    strata: DataFrame, qualified: Column, base: tuple[str, str], other: tuple[str, str]
) -> dict[str, Column]:
    """Counters of positive, negative and equal gaps among the qualified strata."""
    gap = safe_ratio(F.col(other[1]), F.col(other[0])) - safe_ratio(F.col(base[1]), F.col(base[0]))
    sign = F.when(qualified, sign_of_gap(gap))
    return {
        "positive_gap_strata": F.count_if(sign == 1),
        "negative_gap_strata": F.count_if(sign == -1),
        "equal_gap_strata": F.count_if(sign == 0),
    }
