"""Shards of nearly equal bytes by range partitioning on a content key.

The key of a row is a hash of its text, so copies lie together. Splitters are drawn as quantiles of a
size-weighted sample of keys and cut the key space into many fine ranges. The exact bytes of every range are
summed. A key that alone overfills a range (a group of copies) becomes a range of its own and is subdivided
by a hash of the row key. The ranges are then dealt to the shards by their exact totals, the largest first. A row's slot
is the start of its range in the shard plus its place in the range, so no task sorts a whole shard.

The sample is bounded by `SAMPLE_KEYS` keys. It decides where ranges end, never which rows are placed or how
their sizes are counted. The number of ranges is bounded by the parameters, so the range table is small.

Defined results: a null text has no bytes and the checksum of the empty text, its size is 1; rows with equal
keys and texts are placed side by side in any order; a null row key counts as a key of its own; an empty table has
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.shared import written

#: Keys in the sample, on average.
SAMPLE_KEYS = 20_000
#: Ranges for each shard, and the part of a shard that one key may fill before it is subdivided.
RANGES = 64
PARTS = 8


def _unsigned(c: Column) -> Column:
    """The upper 52 bits of a hash as a number from 0 to 1."""
    return F.shiftrightunsigned(c, 12) / F.lit(float(1 << 52))


def balanced_shards(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; `size` is the bytes of the text and one."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        df.select(
            F.col(key).alias("_key"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
        ),
        "shard-rows",
    ).withColumn("u", F.xxhash64(F.coalesce(F.col("_key").cast("string"), F.lit("null")), F.lit("place")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    full = max(1, total // (shards * PARTS))
    by_key = rows.groupBy("h").agg(F.sum("size").alias("b"))
    heavy = by_key.where(F.col("b") > full).select("h", F.ceil(F.col("b") / full).cast("int").alias("cuts"))
    drawn = rows.where(_unsigned(F.xxhash64("u", F.lit("sample"))) < F.col("size") * F.lit(SAMPLE_KEYS / max(total, 1)))
    points = [i / (shards * RANGES) for i in range(1, shards * RANGES)]
    splitters = drawn.agg(F.percentile_approx("h", points, 1_000_000)).first()[0] or []
    splitters = sorted({s for s in splitters if s is not None})
    # each heavy key holds more than 1 / (2 * shards * PARTS) of all bytes, which bounds their number
    placed = rows.join(F.broadcast(heavy), "h", "left")
    number = _range_number(F.col("h"), splitters)
    placed = placed.select(
        "_key", "size", "text_crc32", "h", "u", number.alias("r"),
        F.when(F.col("cuts").isNotNull(), F.col("h")).alias("own"),
        F.coalesce(F.floor(_unsigned(F.col("u")) * F.col("cuts")), F.lit(0)).cast("int").alias("cut"),
    )
    part = ["r", "own", "cut"]
    sums = written(placed.groupBy(*part).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")), "shard-ranges")
    dealt = _deal(sums, part, shards)
    same = [placed[c].eqNullSafe(dealt[c]) for c in part]
    joined = placed.join(F.broadcast(dealt), same[0] & same[1] & same[2]).select(
        "_key", "size", "text_crc32", "h", "u", placed["r"], placed["own"], placed["cut"], "shard", "start"
    )
    place = F.row_number().over(Window.partitionBy(*part).orderBy("h", "u", "_key")) - 1
    return joined.select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("start") + place).cast("long").alias("slot")
    )


def _deal(sums: DataFrame, part: list[str], shards: int) -> DataFrame:
    """The ranges with their shard and first slot: largest first, each to the lightest shard so far.

    The range table has as many rows as the parameters allow, whatever the input, so it fits the driver.
    """
    ranges = sorted(sums.collect(), key=lambda x: (-x.b, x.r, x.own is not None, x.own or 0, x.cut))
    load, filled = [(0, i) for i in range(shards)], [0] * shards
    rows = []
    for x in ranges:
        held, shard = heapq.heappop(load)
        rows.append((*(x[c] for c in part), shard, filled[shard]))
        filled[shard] += x.n
        heapq.heappush(load, (held + x.b, shard))
    return sums.sparkSession.createDataFrame(rows, "r int, own long, cut int, shard int, start long")


def _range_number(h: Column, splitters: list[int]) -> Column:
    """How many splitters are at most h, by halving."""
    if not splitters:
        return F.lit(0)
    ends = F.array(*map(F.lit, splitters))
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]

    def step(at: Column, n: Column) -> Column:
        return F.when(F.get(ends, at + n - 1) <= h, at + n).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
