"""Dimension lookups that never change the number of fact rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.casts import UNKNOWN


@dataclass(frozen=True)
class Lookup:
    """A keyed relation and the attributes taken from it."""

    table: DataFrame
    fact_key: str
    table_key: str
    attributes: tuple[str, ...]


def star_enrich(
    fact: DataFrame, lookups: list[Lookup], unknown: tuple[str, ...] = ()
) -> DataFrame:
    """Left equi-joins in order; the named attributes get the unknown member.

    No broadcast is forced: Spark broadcasts a lookup only below its own size
    limit, and adaptive execution splits skewed shuffle partitions otherwise.
    """
    for lookup in lookups:
        right = lookup.table.select(
            F.col(lookup.table_key).alias("_key"), *lookup.attributes
        )
        fact = fact.join(right, F.col(lookup.fact_key) == F.col("_key"), "left").drop("_key")
    return fact.withColumns({name: F.coalesce(F.col(name), F.lit(UNKNOWN)) for name in unknown})
