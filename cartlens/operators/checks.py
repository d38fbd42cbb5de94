"""Row-level and set-level data checks as small aggregate relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat another row exactly."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n") - F.count(F.lit(1)), F.lit(0)).alias("duplicates")
    )


def fk_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Number of child rows without a parent; a NULL key is an orphan.

    The child is counted per key before the join, so a frequent key is one row;
    the parent is reduced to its distinct keys for the same reason.
    """
    counted = child.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    parents = parent.select(F.col(parent_key).alias("_key")).distinct()
    missing = counted.join(parents, "_key", "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans"))


def reconcile(
    left: DataFrame, right: DataFrame, by: list[str], amount: str, tolerance: float = 0.0
) -> DataFrame:
    """Compare two aggregated relations key by key; a missing side is a mismatch."""
    expected = left.select(*by, F.col(amount).alias("left_amount"))
    actual = right.select(*by, F.col(amount).alias("right_amount"))
    gap = F.bround(F.col("left_amount") - F.col("right_amount"), 6)
    return expected.join(actual, by, "full_outer").withColumns(
        {"difference": gap, "matches": F.coalesce(F.abs(gap) <= tolerance, F.lit(False))}
    )


def row_digest(df: DataFrame) -> Column:
    """MD5 of a row: per column `-` for NULL, else its length in bytes, a colon and its text."""

    def part(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*[part(name) for name in df.columns]).cast("binary"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-independent checksum: sums of the two halves of the row digests."""
    digests = df.select(row_digest(df).alias("_digest"))
    halves = [F.sum(F.conv(F.substring("_digest", at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    zero = F.lit(0).cast("decimal(38,0)")
    return digests.agg(
        F.count(F.lit(1)).alias("rows"),
        F.concat_ws(" ", *[F.coalesce(half, zero).cast("string") for half in halves]).alias("checksum"),
    )


def is_one_row_per_key(df: DataFrame, key: str) -> bool:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d")).first()
    return row["n"] == row["d"]
