"""Total orders over many tasks: range partitions written once, with places that later steps add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.sources.scratch import landed

#: Binary digits of the rows in a stretch of a range.
STRETCH_BITS = 16
_SEQ = (1 << 33) - 1  # the bits of monotonically_increasing_id() that count within a partition


def in_ranges(df: DataFrame, order: list[Column], name: str, scratch: str | None = None) -> DataFrame:
    """df in a total order, written: `_range` is the number of a row's range, ascending, `_seq` its place there.

    Spark samples the keys for the range borders. They differ from run to run, but the written table fixes them for
    every step that reads it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_SEQ))
    return landed(ranged.withColumns({"_range": F.spark_partition_id(), "_seq": place}), name, scratch)


def with_row_number(ranged: DataFrame) -> DataFrame:
    """`no`: the place of each row of `in_ranges` in the whole order, from 0, without sorting again.

    The rows meet the start of their range by stretches of it, so that no task takes whole ranges.
    """
    sizes = ranged.groupBy("_range").agg(F.min("_seq").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # one row for each range, not for each row
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", "_low", "_n", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_low")).alias("_shift"))
    stretch = lambda seq: F.shiftright(seq, STRETCH_BITS)
    held = F.sequence(stretch(F.col("_low")), stretch(F.col("_low") + F.col("_n") - 1))
    starts = starts.select("_range", F.explode(held).alias("_stretch"), "_shift")
    joined = ranged.withColumn("_stretch", stretch(F.col("_seq"))).join(starts, ["_range", "_stretch"])
    return joined.withColumn("no", F.col("_seq") + F.col("_shift")).drop("_range", "_stretch", "_seq", "_shift")
