"""Rows in a total order over many ranges, and their places without one task holding a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.shared import written

#: Bits of monotonically_increasing_id() that count rows within a partition.
SEQ = (1 << 33) - 1


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df written range by range: `_part` is the number of the range, ascending, and `_seq` the place in it.

    Both are fixed by the written table, so whatever reads them sees the same numbers, also after lost executors.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit(SEQ))
    return written(ranged.withColumns({"_part": F.spark_partition_id(), "_seq": seq}), name)


def placed(rows: DataFrame, group: str) -> DataFrame:
    """`idx`, the place from 0 within the group, and `n`, the rows of the group, for rows of `in_order`.

    The order must begin with the group. One row for each group and range is summed; rows are not windowed.
    """
    ranges = rows.groupBy(group, "_part").agg(F.min("_seq").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    line = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(line.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.withColumns({"_shift": before - F.col("_low"), "n": F.sum("_rows").over(line)})
    joined = rows.join(starts.select(group, "_part", "_shift", "n"), [group, "_part"])
    return joined.withColumn("idx", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")
