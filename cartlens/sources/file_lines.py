"""Lines of text files with their places, read by many tasks, and a hash tree over them.

A line is what stands between two line feeds; a carriage return before one belongs to the line. Each task reads byte
ranges. What depends on the lines before a range (its line numbers, whether it begins inside quotes) comes from one row
for each stretch of a range (2^16 lines at most) and a running sum over these rows, so a file of any size is read in
parallel, a shuffle deals stretches and not whole ranges, and the result does not depend on how the file was cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.sources.scratch import landed

#: Nodes that one digest of the tree covers.
FAN = 256
#: Binary digits of the lines in a stretch.
STRETCH_BITS = 16
#: What names a stretch of lines, in order within a file.
PLACE = ["file", "cut", "stretch"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, cut, seq, value, stretch): `cut` is the start of the byte range, `seq` and `stretch` grow along it."""
    found = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("cut"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    return found.withColumn("stretch", F.shiftright("seq", STRETCH_BITS))


def landed_lines(
    spark: SparkSession, paths: list[str], column: Column, name: str, scratch: str | None = None
) -> DataFrame:
    """(file, cut, stretch, seq, column) of the lines of files, written once, so that every reader sees the same ranges."""
    frames = [lines(spark, path).select(*PLACE, "seq", column) for path in paths]
    return landed(reduce(DataFrame.unionByName, frames), name, scratch)


def running(ranges: DataFrame, column: str) -> DataFrame:
    """`before`: the sum of a column over the stretches of the file ahead of each one (one row for each stretch)."""
    ahead = Window.partitionBy("file").orderBy("cut", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("before", F.coalesce(F.sum(column).over(ahead), F.lit(0)))


def numbered(digests: DataFrame) -> DataFrame:
    """(file, no, digest) from landed (file, cut, stretch, seq, digest): line numbers from 0."""
    ranges = digests.groupBy(*PLACE).agg(F.min("seq").alias("low"), F.count(F.lit(1)).alias("n"))
    starts = running(ranges, "n").select(*PLACE, (F.col("before") - F.col("low")).alias("shift"))
    joined = digests.join(starts, PLACE)
    return joined.select("file", (F.col("seq") + F.col("shift")).alias("no"), "digest")


def tree_level(nodes: DataFrame, group: str, levels: int) -> DataFrame:
    """(group, no, digest): the nodes so many levels above (group, no, digest), each SHA-256 over `FAN` neighbours.

    A node is one row of at most `FAN` digests, so a file of any size is spread over all tasks.
    """
    for _ in range(levels):
        listed = F.array_sort(F.collect_list(F.struct("no", "digest")))
        runs = nodes.groupBy(group, F.floor(F.col("no") / FAN).alias("above")).agg(listed.alias("held"))
        digest = F.sha2(F.concat_ws("", "held.digest").cast("binary"), 256)
        nodes = runs.select(group, F.col("above").alias("no"), digest.alias("digest"))
    return nodes


def tree_hash(nodes: DataFrame, group: str, levels: int) -> DataFrame:
    """(group, root), after as many levels as the largest group needs, the same for all groups."""
    return tree_level(nodes, group, levels).select(group, F.col("digest").alias("root"))


def levels_for(count: int) -> int:
    """Levels after which that many nodes have one above them."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FAN), levels + 1
    return levels
